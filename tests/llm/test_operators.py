"""The training-data operators beside plain versions, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm.exact_dedup import drop_exact_duplicates, duplicate_classes
from quillgraph.llm.mixing import EPOCHS, _rows, _times_taken, mix, mixing_plan, source_targets
from quillgraph.llm.pii import KINDS, find_spans, fit_model, redact
from quillgraph.llm.ppm import ORDER, score_documents
from quillgraph.llm.quality_rules import judge, keep_good, quality_measures
from quillgraph.llm.sentence_pieces import PieceEncoder, default_model, encode_pieces
from quillgraph.llm.simhash import drop_near_duplicates, fingerprint, near_duplicate_classes
from quillgraph.llm.substring_dedup import remove_repeats
from quillgraph.llm.token_files import END_ID, encode_frames, pack, read_token_files, unpack

from tests.llm.test_simhash_tree import all_links, classes

SCHEMA = "doc_id long, text string, source string, row string, norm string, id long, fp long, label string"
WORDS = "amber birch cedar delta ember frost grove heron inlet juniper kelp larch maple north ocean pine quartz river stone tidal".split()


def prose(n: int, seed: int) -> str:
    dice = random.Random(seed)
    return " ".join(dice.choice(WORDS) + dice.choice(["", "", "s", "ed", "ly", f"{dice.randrange(99)}"]) for _ in range(n))


def long_line(seed: int) -> str:
    return "".join(random.Random(seed).choice("abcdef0123") for _ in range(30_000))


BODIES = [
    prose(60, 1), prose(60, 1), prose(60, 1).replace(" ", "\n\t ", 3), prose(80, 2), prose(80, 2) + " end", None, "", "   ", "one", "One two",
    prose(30, 3) + " " + prose(45, 4), prose(20, 5) + " " + prose(45, 4) + " tail", long_line(1), prose(4000, 6), "a\nb\na\nb\n\n", "same same same same " * 40,
    "mail ana.ruiz@mail.example.org or 4539578763621486", "é ü 漢字 😀 ▁ x y", prose(60, 1)]
ROWS = ([(i, body, ["s0", "s1", None, ""][i % 4]) for i, body in enumerate(BODIES)]
        + [(3, prose(80, 2), "s0"), (3, prose(25, 9), "s0"), (None, prose(50, 10), "s1"), (None, prose(50, 10), None), (None, None, None)])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*row, "r", "n", -1, -2, "l") for row in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def one_spaced(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def least(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def test_exact_classes(docs):
    groups = defaultdict(list)
    for doc_id, text, _ in ROWS:
        groups[one_spaced(text)].append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        keep, stays = least(ids), True
        for doc_id in sorted(ids, key=lambda i: (i is None, i)):
            want[(doc_id, keep, len(ids), stays and doc_id == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
            stays = False
    got = Counter((r.id, r.keep_id, r.group_size, r.kept, r.full_hash) for r in duplicate_classes(docs, hash_all=True).collect())
    assert got == want


def test_exact_drop_keeps_columns_and_one_row_each(docs, empty):
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert Counter(one_spaced(r.text) for r in out.collect()) == Counter({one_spaced(t): 1 for _, t, _ in ROWS})
    assert drop_exact_duplicates(empty).count() == 0 and duplicate_classes(empty).count() == 0


def plain_components(rows):
    prints = sorted({fingerprint(text) for _, text, _ in rows})
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for doc_id, text, _ in rows:
        members[find(fingerprint(text))].append(doc_id)
    return {p: least(members[find(p)]) for p in prints}


def test_near_duplicates(docs, empty):
    want = plain_components(ROWS)
    got = near_duplicate_classes(docs).collect()
    assert len(got) == len(ROWS)
    assert all(want[r.fp % (1 << 64)] == r.component_id for r in got)
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    # Components are told apart by their fingerprints: two of them are named 3, as rows of different texts repeat that id.
    points = np.unique(np.array([fingerprint(text) for _, text, _ in ROWS], np.uint64))
    group, members = classes(points, all_links(points)), defaultdict(list)
    for doc_id, text, _ in ROWS:
        members[group[fingerprint(text)]].append(doc_id)
    kept = [(group[fingerprint(r.text)], r.doc_id) for r in out.collect()]
    assert sorted(kept, key=str) == sorted(((g, least(ids)) for g, ids in members.items()), key=str)
    assert near_duplicate_classes(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def plain_judgement(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    marked = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = text.split("\n")
    again = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    return (len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text)), again, len(marked),
            len(words) < 20 or 100 * len(marked) > 30 * len(words))


def test_quality_measures(docs, empty):
    got = Counter((r.row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_measures(docs).collect())
    assert got == Counter((doc_id, *plain_judgement(text)) for doc_id, text, _ in ROWS)
    assert keep_good(empty).count() == 0 and keep_good(docs).columns == docs.columns


def test_quality_bands():
    import base64

    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    kept = lambda text: judge(text, squeeze)[6]
    noise = base64.b64encode(random.Random(5).randbytes(6000)).decode()
    assert kept(prose(60, 1)) and kept(prose(4000, 6))
    assert not kept(" ".join(noise[i:i + 200] for i in range(0, len(noise), 200)))
    assert not kept("\n".join(f"item {i} of the list is here" for i in range(3000)))
    assert not kept("few words") and not kept(None)


def test_mixing_targets_are_met(docs, empty):
    rows = _rows(docs, "doc_id", "source", "text")
    taken = _times_taken(rows, mixing_plan(rows)).select("r.source", "r.size", "times", "source_size", "target").collect()
    assert len(taken) == len(ROWS) and all(0 <= r.times <= EPOCHS for r in taken)
    by_source = defaultdict(list)
    for r in taken:
        by_source[r.source].append(r)
    for part in by_source.values():
        words, most = sum(r.size * r.times for r in part), max(r.size for r in part)
        assert words <= 3 * part[0].source_size and abs(words - part[0].target) <= 2 * most
    assert sum(r.size * r.times for r in taken) <= sum(r.size for r in taken)
    out = mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.times for r in taken)
    assert mix(empty).count() == 0


def test_excess_over_the_cap_is_shared_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 2000}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight, open_ = {"a": 1, "b": 2, "c": 3, None: 1}, set(sizes)
    want, left = {}, float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= full
    want |= {s: weight[s] * level for s in open_}
    assert got == pytest.approx(want)


def test_pieces_equal_the_library(docs, empty):
    pieces = PieceEncoder(default_model())
    for text in [t for t in BODIES if t] + [" ", "  a  b ", "a\tb\n\nc", "x ▁y ▁▁ z", "<s> </s>", "\x00a", "<0x41>", "\n", "\na", "word,word;_,. (a),b:c! ?"]:
        assert pieces.encode(text) == pieces.library.encode(text), text
        assert pieces.decode(pieces.encode(text)) == pieces.library.decode(pieces.library.encode(text))
    got = Counter((r.row.doc_id, tuple(r.ids), r.decoded) for r in encode_pieces(docs).collect())
    library = pieces.library
    assert got == Counter((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t, _ in ROWS)
    assert encode_pieces(empty).count() == 0


def test_repeated_passages(docs, empty):
    first = {}
    texts = [(i if i is not None else math.inf, t) for i, t, _ in ROWS]
    windows = lambda words: [tuple(words[i:i + 20]) for i in range(len(words) - 19)]
    for doc_id, text in texts:
        for at, w in enumerate(windows((text or "").encode().split())):
            first[w] = min(first.get(w, (doc_id, at)), (doc_id, at))
    want = Counter()
    for (doc_id, text), (raw_id, _, _) in zip(texts, ROWS):
        words = (text or "").encode().split()
        gone = {at + k for at, w in enumerate(windows(words)) if first[w] < (doc_id, at) for k in range(20)}
        want[(raw_id, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())] += 1
    assert Counter((r.row.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs).collect()) == want
    assert sum(k[2] * n for k, n in want.items()) > 100
    assert remove_repeats(empty).count() == 0


def test_ppm_equals_a_plain_trie(docs, empty):
    trie, words = [defaultdict(Counter) for _ in range(ORDER + 1)], Counter()
    train = [t for i, t, _ in ROWS if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    for text in train:
        raw = (text or "").encode()
        words.update(raw.lower().split())
        words[None] += 1
        padded = b"\xff" * ORDER + raw + b"\xfe"
        for i in range(ORDER, len(padded)):
            for k in range(ORDER + 1):
                trie[k][padded[i - k:i]][padded[i]] += 1

    def share(context, symbol):
        out, gone = 1.0, set()
        for k in range(ORDER, -1, -1):
            seen = {s: n for s, n in trie[k].get(context[ORDER - k:], {}).items()}
            if not seen:
                continue
            total, new = sum(n for s, n in seen.items() if s not in gone), sum(s not in gone for s in seen)
            if symbol in seen:
                return out * seen[symbol] / (total + new)
            if total + new:
                out *= new / (total + new)
            gone |= set(seen)
        return out / (256 - len(gone))

    assert sum(share(b" the"[:ORDER], s) for s in range(256)) == pytest.approx(1)
    tokens, distinct = sum(words.values()), len(words)
    want = {}
    for i, text, _ in ROWS:
        raw = (text or "").encode()
        if len(raw) > 5000:
            continue
        padded = b"\xff" * ORDER + raw + b"\xfe"
        mine = [*raw.lower().split(), None]
        want[(i, text)] = (len(mine), sum(words[w] > 0 for w in mine), sum(math.log10((words[w] + 1) / (tokens + distinct + 1)) for w in mine),
                           sum(math.log10(share(padded[j - ORDER:j], padded[j])) for j in range(ORDER, len(padded))))
    got = score_documents(docs).collect()
    assert len(got) == len(ROWS) and {r.train_tokens for r in got} == {tokens}
    for r in got:
        if (r.row.doc_id, r.row.text) in want:
            assert (r.n_tokens, r.n_known, r.base_score, r.score) == pytest.approx(want[(r.row.doc_id, r.row.text)])
    assert score_documents(empty).count() == 0


def test_words_round_trip():
    dice = np.random.default_rng(1)
    for n in (0, 1, 5, 255, 256, 257, 3000):
        for high in (1, 2, 300, 50_257, 1 << 31, 1 << 59):
            values = dice.integers(0, high, n).astype(np.uint64)
            if n > 10:
                values[5:9], values[7], values[-1] = 1 << 62, (15 << 60) + 3, (1 << 64) - 1
            words, offsets = pack(values)
            assert (unpack(words, offsets, n) == values).all()


def test_parts_of_odd_texts_encode_as_whole_ones():
    from quillgraph.llm.token_files import PartEncoder, default_tokenizer
    dice = random.Random(4)
    marks = ["a", "B", "z", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "\u2009", "\u0085", "\u1680", "é", "×", "÷", "à", "ß", "漢", "字", "😀", ".", ",", "!?", ";", ":", "'s", "'t",
             "'", "9", "12", "½", "€", "—", "<|endoftext|>", "<", "|", ">", "\u200b", "\x1c", "\x00", "_", "-", "ÿ", "Ā", "ж"]
    texts = ["".join(dice.choices(marks, k=dice.randrange(25))) for _ in range(8000)] + [None, "", " ", "\n", " a", "a ", "x" * 100_000, " \n" * 5000]
    parts = PartEncoder(default_tokenizer())
    for _ in range(2):  # the second time from memory
        ids, counts = parts.encode_texts(pa.array(texts))
        ends = np.cumsum(counts)
        for text, end, n in zip(texts, ends.tolist(), counts.tolist()):
            assert ids[end - n:end].tolist() == parts.library.encode(text or "", add_special_tokens=False).ids
    assert parts.encode_texts(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    from quillgraph.llm.token_files import default_tokenizer
    library = Tokenizer.from_file(default_tokenizer())
    got = sorted(read_token_files(encode_frames(docs)).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [END_ID])) for i, t, _ in ROWS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert read_token_files(encode_frames(empty)).count() == 0


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)}
    return sorted(((m.start(), KINDS.index(k), m.end()) for k, (p, ok) in found.items() for m in re.finditer(p, text or "") if ok(m)))


SPANS = ["a@b.c-d@e.f x a@b.c_d@e.f..", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4539 5787 6362 1486 4539578763621486-", "x 4539-5787-6362-1486 1 +1 (017) 555-7713.",
         "😀é a@é.fr b@c.fr +4", "12 4539578763621486", "5 4539578763621486", "call (212) 555-0187 or mail bob (at) example (dot) com", "order 123 456 7890", "a" * 200_000, "1" * 50_000,
         "a@" * 3000, "+1 " + " " * 50_000]


def test_spans(spark, docs, empty):
    rows = [(i, t) for i, t in enumerate(SPANS + BODIES)]
    model = fit_model(docs)
    got = find_spans(spark.createDataFrame(rows, "doc_id long, text string"), model=model).select("row.doc_id", "row.text", "base", "added", redact(
        F.coalesce("row.text", F.lit("")), F.col("base")).alias("clean")).collect()
    for r in got:
        assert [(s.start, KINDS.index(s.kind), s.end) for s in r.base] == plain_spans(r.text)
        assert all(s.end <= b.start or s.start >= b.end for s in r.added for b in r.base)
    by_id = {r.doc_id: r for r in got}
    assert [SPANS[7][s.start:s.end] for s in by_id[7].added] == ["(212) 555-0187", "bob (at) example (dot) com"] or {s.kind for s in by_id[7].added} == {"phone", "email"}
    assert not by_id[8].added
    assert by_id[len(SPANS) + 16].clean == "mail [email] or [card]"
    assert find_spans(empty, model=model).count() == 0


def test_windows_are_sorted_some_at_a_time(monkeypatch):
    """What a task of op3 holds does not grow with an Arrow batch."""
    from quillgraph.llm import substring_dedup as S

    monkeypatch.setattr(S, "MOST_WINDOWS", 1000)
    held = list(S._some((np.zeros(300),) for _ in range(50)))
    assert sum(len(part) for parts in held for (part,) in parts) == 15000
    assert max(sum(len(part) for (part,) in parts) for parts in held) <= 1200
