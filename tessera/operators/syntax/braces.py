"""Languages with braces: statements by their brackets and line ends, definitions by how a statement begins."""

from __future__ import annotations

import re

from tessera.operators.syntax.base import Node, Token, match_brackets, tokens

_TOKENS = re.compile(
    r"""(?P<space>[ \t\f\r]+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"?|`(?:[^`\\]|\\.)*`?|'(?:[^'\\\n]|\\.){0,40}')"""
    r"""|(?P<end>\n)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<directive>(?<![^\n])[ \t]*\#[^\n]*)|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>.)""",
    re.S,
)
#: The same where # begins a comment, and strings may go on over lines.
_HASH_TOKENS = re.compile(
    r"""(?P<space>[ \t\f\r]+)|(?P<comment>(?<![^\s;(){}])\#[^\n]*)|(?P<string>"(?:[^"\\]|\\.)*"?|'[^']*'?|`(?:[^`\\]|\\.)*`?)"""
    r"""|(?P<end>\n)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<word>[^\W\d][\w-]*)|(?P<number>\d[\w.]*)|(?P<mark>\\.|.)""",
    re.S,
)
_N = r"(?P<name>[^\W\d]\w*)"
_JS = [
    (r"import\b(?!\s*[(.])", "import_statement"),
    (r"export\b", "export_statement"),
    (rf"(?:async\s+)?function\s+{_N}", "function_declaration"),
    (rf"(?:async\s+)?function\s*\*\s*{_N}", "generator_function_declaration"),
    (rf"(?:abstract\s+)?class\s+{_N}", "class_declaration"),
    (rf"interface\s+{_N}", "interface_declaration"),
    (rf"(?:const\s+)?enum\s+{_N}", "enum_declaration"),
    (rf"(?:declare\s+)?type\s+{_N}[^=\n]*=", "type_alias_declaration"),
    (rf"(?:const|let)\s+{_N}?", "lexical_declaration"),
    (rf"var\s+{_N}?", "variable_declaration"),
]
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|open|override|sealed|data|inline|suspend|synchronized|native|default|strictfp|companion|@[\w.]+(?:\([^)]*\))?)\s+)*"
_MODIFIERS_CS = r"(?:(?:public|private|protected|internal|static|sealed|abstract|override|virtual|async|partial|readonly|extern|unsafe|new|\[[^\]]*\])\s+)*"
_MODIFIERS_SWIFT = r"(?:(?:public|private|fileprivate|internal|open|static|final|override|mutating|lazy|weak|indirect|@\w+(?:\([^)]*\))?)\s+)*"
_MODIFIERS_SCALA = r"(?:(?:private|protected|implicit|override|final|sealed|abstract|lazy|@\w+)(?:\[\w+\])?\s+)*"
#: Beginning of a statement -> node kind, in the order they are tried.
LANGUAGES: dict[str, list[tuple[str, str]]] = {
    "javascript": _JS,
    "typescript": _JS,
    "tsx": _JS,
    "go": [
        (r"package\b", "package_clause"),
        (r"import\b", "import_declaration"),
        (rf"func\s*\([^)]*\)\s*{_N}", "method_declaration"),
        (rf"func\s+{_N}", "function_declaration"),
        (r"type\b", "type_declaration"),
        (r"const\b", "const_declaration"),
        (r"var\b", "var_declaration"),
    ],
    "java": [
        (r"package\b", "package_declaration"),
        (r"import\b", "import_declaration"),
        (rf"{_MODIFIERS}class\s+{_N}", "class_declaration"),
        (rf"{_MODIFIERS}interface\s+{_N}", "interface_declaration"),
        (rf"{_MODIFIERS}enum\s+{_N}", "enum_declaration"),
        (rf"{_MODIFIERS}record\s+{_N}", "record_declaration"),
        (rf"{_MODIFIERS}(?:<[^>]*>\s*)?(?!(?:return|new|throw|else|if|for|while|switch)\b)[\w.<>,\[\]?]+(?:\s*\[\])*\s+{_N}\s*\(", "method_declaration"),
    ],
    "kotlin": [
        (r"package\b", "package_header"),
        (r"import\b", "import_declaration"),
        (rf"{_MODIFIERS}(?:enum\s+|annotation\s+)?(?:class|interface)\s+{_N}", "class_declaration"),
        (rf"{_MODIFIERS}object\s+{_N}", "object_declaration"),
        (rf"{_MODIFIERS}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?{_N}", "function_declaration"),
        (rf"{_MODIFIERS}va[lr]\s+{_N}", "property_declaration"),
    ],
    "rust": [
        (r"(?:pub(?:\([^)]*\))?\s+)?use\b", "use_declaration"),
        (rf"(?:pub(?:\([^)]*\))?\s+)?mod\s+{_N}", "mod_item"),
        (rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*fn\s+{_N}", "function_item"),
        (rf"(?:pub(?:\([^)]*\))?\s+)?struct\s+{_N}", "struct_item"),
        (rf"(?:pub(?:\([^)]*\))?\s+)?enum\s+{_N}", "enum_item"),
        (rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+{_N}", "trait_item"),
        (rf"(?:unsafe\s+)?impl(?:\s*<[^{{]*?>)?\s+(?:[^{{]*?\sfor\s+)?{_N}", "impl_item"),
        (rf"(?:pub(?:\([^)]*\))?\s+)?const\s+{_N}", "const_item"),
        (rf"(?:pub(?:\([^)]*\))?\s+)?type\s+{_N}", "type_item"),
        (r"let\b", "let_declaration"),
    ],
    "csharp": [
        (r"(?:global\s+)?using\b(?!\s*\()", "using_directive"),
        (r"namespace\s+(?P<name>[\w.]+)", "namespace_declaration"),
        (rf"{_MODIFIERS_CS}class\s+{_N}", "class_declaration"),
        (rf"{_MODIFIERS_CS}interface\s+{_N}", "interface_declaration"),
        (rf"{_MODIFIERS_CS}struct\s+{_N}", "struct_declaration"),
        (rf"{_MODIFIERS_CS}enum\s+{_N}", "enum_declaration"),
        (rf"{_MODIFIERS_CS}record\s+(?:class\s+|struct\s+)?{_N}", "record_declaration"),
        (rf"{_MODIFIERS_CS}(?!(?:return|new|throw|else|if|for|foreach|while|switch|await|lock|using)\b)[\w.<>,\[\]?]+(?:\s*\[\])*\s+{_N}\s*(?:<[^>]*>)?\s*\(", "method_declaration"),
    ],
    "php": [
        (r"namespace\s+(?P<name>[\w\\]+)", "namespace_definition"),
        (r"use\b(?!\s*\()", "namespace_use_declaration"),
        (rf"(?:(?:abstract|final|readonly)\s+)*class\s+{_N}", "class_declaration"),
        (rf"interface\s+{_N}", "interface_declaration"),
        (rf"trait\s+{_N}", "trait_declaration"),
        (rf"enum\s+{_N}", "enum_declaration"),
        (rf"(?:(?:public|private|protected|static|abstract|final)\s+)+function\s*&?\s*{_N}", "method_declaration"),
        (rf"function\s*&?\s*{_N}", "function_definition"),
    ],
    "swift": [
        (r"import\b", "import_declaration"),
        (rf"{_MODIFIERS_SWIFT}protocol\s+{_N}", "protocol_declaration"),
        (rf"{_MODIFIERS_SWIFT}(?:class|struct|enum|actor|extension)\s+(?!func\b|var\b){_N}", "class_declaration"),
        (rf"{_MODIFIERS_SWIFT}func\s+{_N}", "function_declaration"),
        (rf"{_MODIFIERS_SWIFT}(?:var|let)\s+{_N}", "property_declaration"),
    ],
    "scala": [
        (r"package\b", "package_clause"),
        (r"import\b", "import_declaration"),
        (rf"{_MODIFIERS_SCALA}(?:case\s+)?class\s+{_N}", "class_definition"),
        (rf"{_MODIFIERS_SCALA}(?:case\s+)?object\s+{_N}", "object_definition"),
        (rf"{_MODIFIERS_SCALA}trait\s+{_N}", "trait_definition"),
        (rf"{_MODIFIERS_SCALA}def\s+{_N}", "function_definition"),
        (rf"{_MODIFIERS_SCALA}val\s+{_N}", "val_definition"),
    ],
    "css": [
        (r"@import\b", "import_statement"),
        (r"@media\b", "media_statement"),
        (r"@[\w-]+", "at_rule"),
        (r"[^{;]+\{", "rule_set"),
        (r"[\w-]+\s*:", "declaration"),
    ],
    "bash": [
        (r"function\s+(?P<name>[\w-]+)", "function_definition"),
        (r"(?P<name>[\w-]+)\s*\(\s*\)", "function_definition"),
        (r"[^\W\d]\w*=", "variable_assignment"),
    ],
    "c": [
        (r"typedef\b", "type_definition"),
        (rf"struct\s+{_N}\s*\{{", "struct_specifier"),
        (rf"enum\s+{_N}\s*\{{", "enum_specifier"),
        (r"(?!(?:return|else|if|for|while|switch|do)\b)[\w*\s]+?\**\s*[^\W\d]\w*\s*\([^;{]*\)\s*\{", "function_definition"),
    ],
    "cpp": [
        (rf"namespace\s+{_N}", "namespace_definition"),
        (r"using\b", "using_declaration"),
        (rf"class\s+{_N}", "class_specifier"),
        (rf"struct\s+{_N}", "struct_specifier"),
        (r"(?!(?:return|else|if|for|while|switch|do)\b)[\w:<>,*&~\s]+?[\w~]\s*\([^;{]*\)[^;{]*\{", "function_definition"),
    ],
}
_TYPE_NAMED = {"impl_item", "struct_item", "enum_item", "trait_item", "type_item", "class_specifier", "struct_specifier"}
#: Of these a name is a child, not the field `name`.
_UNNAMED_FIELD = {"impl_item", "lexical_declaration", "variable_declaration", "function_definition", "property_declaration"}
_HASH = {"bash", "php"}
_NAMED_FUNCTIONS = {"php", "bash", "scala"}
_ROOT = {"csharp": "compilation_unit", "scala": "compilation_unit", "php": "program", "bash": "program", "css": "stylesheet", "javascript": "program", "typescript": "program", "tsx": "program", "java": "program", "c": "translation_unit", "cpp": "translation_unit"}
_BODY = {"class_declaration": "class_body", "interface_declaration": "interface_body", "enum_declaration": "enum_body", "class_specifier": "field_declaration_list", "struct_specifier": "field_declaration_list", "impl_item": "declaration_list", "trait_item": "declaration_list", "mod_item": "declaration_list", "struct_item": "field_declaration_list", "enum_item": "enum_variant_list"}
_METHOD = re.compile(rf"(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)\s+)*[*#]?\s*{_N}\s*(?:<[^>]*>)?\s*\(")
_GOES_ON = re.compile(r"[,;).:=?\]]|(?:else|catch|finally|while|from|as)\b")
_SEMICOLONS = {"c", "cpp", "java", "rust", "csharp", "php", "css"}
_SINGLE = {"(": ")", "[": "]", "{": "}"}


def parse(text: str, language: str) -> Node:
    root = Node(_ROOT.get(language, "source_file"), 0, len(text))
    if language == "php" and (tag := re.match(r"\s*<\?php\b", text)):
        root.add("php_tag", tag.end() - 5, tag.end())
        text = " " * tag.end() + text[tag.end() :]
    toks = tokens(text, _HASH_TOKENS if language == "bash" else _TOKENS)
    if language in _HASH:
        toks = [Token("comment", t.end - len(t.text.lstrip()), t.end, t.text.lstrip()) if t.kind == "directive" else t for t in toks]
    comments = [t for t in toks if t.kind == "comment"]
    code = [t for t in toks if t.kind != "comment"]
    pairs, wrong = match_brackets(code)
    work = [(root, 0, len(code), "")]
    containers: list[Node] = [root]
    while work:
        into, i, stop, owner = work.pop()
        while i < stop:
            if code[i].kind == "end" or code[i].text == ";":
                i += 1
                continue
            if code[i].kind == "directive":
                body = code[i].text.strip()
                at = code[i].end - len(code[i].text.lstrip())
                into.add("preproc_include" if re.match(r"#\s*include", body) else "preproc_def" if re.match(r"#\s*define", body) else "attribute_item" if body.startswith("#[") else "preproc_call", at, code[i].end)
                i += 1
                continue
            end, brace = _statement(code, pairs, i, stop, language)
            node = _classify(text, code, i, end, brace, language, owner, into)
            if brace is not None:
                kind = _BODY.get(node.kind, "statement_block" if language in ("javascript", "typescript", "tsx") else "block")
                close = pairs.get(brace)
                field = "body" if node.kind != "expression_statement" else None
                target = node
                if node.kind in ("lexical_declaration", "export_statement") and node.children and node.children[-1].kind != "identifier":
                    target = _innermost(node)
                    kind = _BODY.get(target.kind, kind)
                body = target.add(kind, code[brace].start, code[close].end if close is not None else text_end(code, end), field=field)
                containers.append(body)
                work.append((body, brace + 1, close if close is not None else end, target.kind))
            i = max(end, i + 1)
    containers.sort(key=lambda n: (n.start, -n.end))
    for c in comments:
        home = [n for n in containers if n.start <= c.start and c.end <= n.end]
        doc = c.text.startswith(("/**", "///", "//!", "/*!"))
        kind = "comment" if language not in ("rust", "java", "kotlin") else "block_comment" if c.text.startswith("/*") else "line_comment"
        node = max(home, key=lambda n: n.depth if n.depth else n.start).add(kind, c.start, c.end, extra=True)
        if doc and language == "rust":
            node.add("doc_comment", c.start + 3, c.end)
    for i in wrong:
        root.add("ERROR", code[i].start, code[i].end, error=True)
    return root


def text_end(code: list[Token], end: int) -> int:
    return code[min(end, len(code)) - 1].end


def _innermost(node: Node) -> Node:
    while node.children and node.children[-1].kind in ("variable_declarator", "arrow_function", "function_declaration", "class_declaration", "lexical_declaration", "interface_declaration", "enum_declaration"):
        node = node.children[-1]
    return node


def _statement(code: list[Token], pairs: dict[int, int], i: int, stop: int, language: str) -> tuple[int, int | None]:
    """The index after a statement and that of the brace that opens its body."""
    brace, start = None, i
    while i < stop:
        t = code[i]
        if t.text == ";":
            return i + 1, brace
        if t.kind == "open":
            close = pairs.get(i)
            if t.text == "{" and brace is None:
                brace = i
            i = close + 1 if close is not None else stop
            if t.text == "{":
                after = next((x for x in code[i:stop] if x.kind != "end"), None)
                if after is None or not _GOES_ON.match(after.text) or code[i : i + 1] and code[i].kind == "end" and after.kind == "word" and after.text not in ("else", "catch", "finally"):
                    return i, brace
            continue
        if t.kind == "end" and i > start:
            after = next((x for x in code[i:stop] if x.kind != "end"), None)
            before = code[i - 1]
            if after is None:
                return i, brace
            if language not in _SEMICOLONS and not (before.kind == "mark" and before.text not in "*>!?" or after.text in "{.?:=&|+-*/,)" and after.text != "*"):
                return i, brace
        i += 1
    return stop, brace


def _classify(text: str, code: list[Token], i: int, end: int, brace: int | None, language: str, owner: str, into: Node) -> Node:
    last = next(t for t in reversed(code[i:end]) if t.kind != "end")
    start, stop = code[i].start, last.end
    head = text[start : code[brace].start + 1 if brace is not None else stop]
    if owner in ("class_declaration", "class_specifier") and language in ("javascript", "typescript", "tsx") and (m := _METHOD.match(head)):
        node = into.add("method_definition", start, stop)
        node.add("property_identifier", start + m.start("name"), start + m.end("name"), field="name")
        return node
    for pattern, kind in LANGUAGES[language]:
        m = re.compile(pattern, re.S).match(head)
        if m:
            break
    else:
        return into.add("command" if language == "bash" else "expression_statement", start, stop)
    node = into.add(kind, start, stop)
    name = m.groupdict().get("name")
    if kind in ("lexical_declaration", "variable_declaration") and name:
        d = node.add("variable_declarator", start + m.start("name"), stop)
        d.add("identifier", start + m.start("name"), start + m.end("name"), field="name")
        if "=>" in head or re.search(r"=\s*(?:async\s+)?function\b", head):
            at = start + head.index("=", m.end("name") - 0) + 1
            at += len(text[at:stop]) - len(text[at:stop].lstrip())
            d.add("arrow_function", at, stop, field="value")
    elif kind == "function_definition" and language in ("c", "cpp"):
        found = re.search(r"([\w~:]+)\s*\(", head)
        if found:
            d = node.add("function_declarator", start + found.start(), start + head.rindex(")") + 1, field="declarator")
            d.add("identifier", start + found.start(1), start + found.end(1), field="declarator")
    elif name:
        node.add("type_identifier" if kind in _TYPE_NAMED else "identifier", start + m.start("name"), start + m.end("name"), field=None if kind in _UNNAMED_FIELD and language not in _NAMED_FUNCTIONS else "name")
    elif kind in ("package_declaration", "package_header"):
        found = re.compile(r"\s+([\w.]+)").match(head, m.end())
        if found:
            node.add("scoped_identifier" if "." in found[1] else "identifier", start + found.start(1), start + found.end(1))
    if kind == "export_statement":
        _exported(text, node, head, m.end(), start, stop)
    elif kind == "import_declaration" and language == "go":
        for s in re.finditer(r'(?:[\w.]+[ \t]+)?"[^"]*"', text[start:stop]):
            node.add("import_spec", start + s.start(), start + s.end())
    elif kind == "type_declaration":
        for s in re.finditer(r"(?:type|\(|\n)\s*(\w+)\s+(struct|interface)?", text[start:stop] if "(" in head[:8] else head):
            spec = node.add("type_spec", start + s.start(1), stop)
            spec.add("type_identifier", start + s.start(1), start + s.end(1), field="name")
            if s[2]:
                spec.add(f"{s[2]}_type", start + s.start(2), stop, field="type")
            if "(" not in head[:8]:
                break
    return node


def _exported(text: str, node: Node, head: str, at: int, start: int, stop: int) -> None:
    source = re.search(r"\bfrom\s*(['\"][^'\"]*['\"])", text[start:stop])
    if source and re.match(r"\s*[*{]|\s*type\s*\{", head[at:]):
        node.add("string", start + source.start(1), start + source.end(1), field="source")
        return
    rest = re.compile(r"\s*(?:default\b)?\s*").match(head, at).end()
    for pattern, kind in _JS[2:]:
        m = re.compile(pattern, re.S).match(head, rest)
        if m:
            inner = node.add(kind, start + rest, stop, field="declaration")
            name = m.groupdict().get("name")
            if name and kind in ("lexical_declaration", "variable_declaration"):
                d = inner.add("variable_declarator", start + m.start("name"), stop)
                d.add("identifier", start + m.start("name"), start + m.end("name"), field="name")
            elif name:
                inner.add("identifier", start + m.start("name"), start + m.end("name"), field="name")
            return
