"""The token vocabulary and the token classes of the source encoder."""

from __future__ import annotations

# Sequence length, special ids, and the ordered vocabulary (id = position).
SEQUENCE_LENGTH = 128
PAD_ID = 0
UNKNOWN_ID = 1
NODE_TYPES = (
    "Program",
    "FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression",
    "VariableDeclaration", "VariableDeclarator",
    "ExpressionStatement", "ReturnStatement",
    "IfStatement", "WhileStatement", "DoWhileStatement",
    "ForStatement", "ForInStatement", "ForOfStatement",
    "BlockStatement", "BreakStatement", "ContinueStatement",
    "SwitchStatement", "SwitchCase",
    "ThrowStatement", "TryStatement", "CatchClause",
    "BinaryExpression", "LogicalExpression", "UnaryExpression",
    "UpdateExpression", "AssignmentExpression", "ConditionalExpression",
    "CallExpression", "MemberExpression", "NewExpression", "SequenceExpression",
    "ArrayExpression", "ObjectExpression", "Property", "SpreadElement",
    "TemplateLiteral", "TemplateElement", "TaggedTemplateExpression",
    "Identifier", "Literal", "ThisExpression", "Super",
    "ClassDeclaration", "ClassBody", "MethodDefinition",
    "ImportDeclaration", "ExportNamedDeclaration", "ExportDefaultDeclaration",
    "YieldExpression", "AwaitExpression",
    "ObjectPattern", "ArrayPattern", "RestElement", "AssignmentPattern",
)
SUB_TOKENS = (
    "+", "-", "*", "/", "%", "**",
    "===", "!==", "==", "!=", "<", "<=", ">", ">=",
    "&&", "||", "??", "!", "~", "typeof", "void", "delete", "instanceof", "in",
    "=", "+=", "-=", "*=", "/=", "%=", "**=",
    "++", "--",
    "var", "let", "const",
    "Math.sqrt", "Math.exp", "Math.log", "Math.pow", "Math.abs",
    "Math.floor", "Math.ceil", "Math.round", "Math.PI", "Math.max", "Math.min",
    "length", "push", "pop", "map", "filter", "reduce", "forEach", "find", "slice",
    "true", "false", "null", "undefined",
)
VOCABULARY = ("<PAD>", "<UNK>", *NODE_TYPES, *SUB_TOKENS)
TOKEN_ID = {token: i for i, token in enumerate(VOCABULARY)}

# What a source token stands for: node type, and whether the token itself follows as sub-token.
WITH_SUB_TOKEN = {
    "BinaryExpression": ("+", "-", "*", "/", "%", "**", "===", "!==", "==", "!=", "<", "<=", ">", ">=", "instanceof", "in"),
    "LogicalExpression": ("&&", "||", "??"),
    "UnaryExpression": ("!", "~", "typeof", "void", "delete"),
    "AssignmentExpression": ("=", "+=", "-=", "*=", "/=", "%=", "**="),
    "UpdateExpression": ("++", "--"),
    "VariableDeclaration": ("var", "let", "const"),
    "MemberExpression": (
        "Math.sqrt", "Math.exp", "Math.log", "Math.pow", "Math.abs", "Math.floor", "Math.ceil", "Math.round",
        "Math.PI", "Math.max", "Math.min", "length", "push", "pop", "map", "filter", "reduce", "forEach", "find", "slice"),
    "Literal": ("true", "false", "null"),
}
ALONE = {
    "function": "FunctionDeclaration", "=>": "ArrowFunctionExpression", "return": "ReturnStatement",
    "if": "IfStatement", "while": "WhileStatement", "do": "DoWhileStatement", "for": "ForStatement",
    "{": "BlockStatement", "break": "BreakStatement", "continue": "ContinueStatement",
    "switch": "SwitchStatement", "case": "SwitchCase", "throw": "ThrowStatement", "try": "TryStatement",
    "catch": "CatchClause", "?": "ConditionalExpression", "new": "NewExpression", "[": "ArrayExpression",
    "...": "SpreadElement", "this": "ThisExpression", "super": "Super", "class": "ClassDeclaration",
    "import": "ImportDeclaration", "export": "ExportNamedDeclaration", "yield": "YieldExpression",
    "await": "AwaitExpression",
}
# Words and marks that stand for no node of their own.
SILENT = ("else", "finally", "default", "of", "from", "extends", "static", "async", "(", ")", "}", "]", ",", ";", ":", ".")

# One alternation; order matters. The string parts are unrolled so that long literals do not recurse.
SOURCE_PATTERN = (
    r"//[^\n]*|/\*[\s\S]*?\*/"
    r'|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"'
    r"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"
    r"|`[^`\\]*(?:\\[\s\S][^`\\]*)*`"
    r"|Math\.[A-Za-z0-9_]+|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*"
    r"|===|!==|\*\*=|\.\.\.|=>|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|\*\*"
    r"|[^ \t\r\n\f\x0B]"
)


def encoding_table() -> dict[str, list[int]]:
    """Token -> ids it is encoded to: node type, then the sub-token where there is one."""
    table: dict[str, list[int]] = {}
    for node, tokens in WITH_SUB_TOKEN.items():
        for token in tokens:
            table[token] = [TOKEN_ID[node], TOKEN_ID[token]]
    for token, node in ALONE.items():
        table[token] = [TOKEN_ID[node]]
    for token in SILENT:
        table[token] = []
    return table
