"""A small reader of Java declarations: tokens and a brace tracker, no external parser.

It knows packages, imports, type declarations of all five kinds at any nesting, their
members' signatures and annotations; bodies of methods are skipped.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[A-Za-z_$][\w$]*|\d[\w.]*|\.\.\.|\S', re.S)
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "default", "synchronized", "native", "strictfp", "transient", "volatile", "sealed"}
_CLOSE = {"(": ")", "{": "}", "[": "]", "<": ">"}


class Reader:
    """Declarations of one compilation unit, gathered in lists."""

    def __init__(self, source: str):
        self.source = source
        self.tok: list[str] = []
        self.pos: list[int] = []
        for m in _TOKEN.finditer(source):
            if not m[0].startswith(("//", "/*")):
                self.tok.append(m[0])
                self.pos.append(m.start())
        self.package, self.imports, self.statics, self.wildcards = "", [], [], []
        self.classes: list[dict] = []
        self.methods: list[dict] = []
        self.refs: list[dict] = []
        self.fields: list[dict] = []
        self._unit()

    # -- helpers

    def at(self, i: int) -> str:
        return self.tok[i] if i < len(self.tok) else ""

    def line(self, i: int) -> int:
        return self.source.count("\n", 0, self.pos[i]) + 1

    def close(self, i: int) -> int:
        """The place after the bracket that closes the one at i."""
        open_, shut, depth = self.tok[i], _CLOSE[self.tok[i]], 0
        while i < len(self.tok):
            depth += (self.tok[i] == open_) - (self.tok[i] == shut)
            i += 1
            if not depth:
                break
        return i

    def dotted(self, i: int) -> tuple[str, int]:
        parts = [self.at(i)]
        i += 1
        while self.at(i) == "." and re.match(r"[A-Za-z_$*]", self.at(i + 1)):
            parts.append(self.at(i + 1))
            i += 2
        return ".".join(parts), i

    def modifiers(self, i: int) -> tuple[list[str], list[tuple[str, str]], int]:
        """Modifier words and annotations (name, text of the brackets) from i on."""
        words, notes = [], []
        while True:
            t = self.at(i)
            if t == "@" and self.at(i + 1) != "interface":
                name, i = self.dotted(i + 1)
                end = self.close(i) if self.at(i) == "(" else i
                text = self.source[self.pos[i] : self.pos[end - 1] + 1] if end > i else ""
                notes.append((name, text))
                i = end
            elif t in _MODIFIERS:
                words.append(t)
                i += 1
            elif t == "non" and self.at(i + 1) == "-" and self.at(i + 2) == "sealed":
                i += 3
            else:
                return words, notes, i

    def type_ref(self, i: int) -> tuple[str, str, int]:
        """(dotted name without type arguments, erased simple type, next place) of a type."""
        _, _, i = self.modifiers(i)
        if self.at(i) == "?":
            return "?", "?", i + 1
        name = self.at(i)
        i += 1
        while True:
            if self.at(i) == "<":
                i = self.close(i)
            elif self.at(i) == "." and re.match(r"[A-Za-z_$@]", self.at(i + 1)):
                _, _, i = self.modifiers(i + 1)
                name += "." + self.at(i)
                i += 1
            else:
                break
        erased = name.rpartition(".")[2]
        while self.at(i) == "[" and self.at(i + 1) == "]":
            erased += "[]"
            i += 2
        return name, erased, i

    def type_list(self, i: int) -> tuple[list[str], int]:
        names = []
        while True:
            name, _, i = self.type_ref(i)
            names.append(name)
            if self.at(i) != ",":
                return names, i
            i += 1

    # -- grammar

    def _unit(self) -> None:
        i = 0
        while i < len(self.tok):
            words, notes, j = self.modifiers(i)
            t = self.at(j)
            if t == "package":
                self.package, j = self.dotted(j + 1)
            elif t == "import":
                j += 1
                static = self.at(j) == "static"
                name, j = self.dotted(j + static)
                (self.statics if static else self.wildcards if name.endswith(".*") else self.imports).append(name.removesuffix(".*") if not static else name)
            elif (end := self._type(j, words, notes, None)) is not None:
                i = end
                continue
            i = max(j, i) + 1

    def _type(self, i: int, words: list[str], notes: list[tuple[str, str]], outer: str | None) -> int | None:
        """Reads the type declaration at i, if there is one; gives the place after it."""
        start, t = i, self.at(i)
        kind = t if t in ("class", "interface", "enum") else "annotation" if t == "@" and self.at(i + 1) == "interface" else None
        if t == "record" and re.match(r"[A-Za-z_$]", self.at(i + 1)) and self.at(i + 2) in "(<":
            kind = "record"
        if kind is None or not re.match(r"[A-Za-z_$]", self.at(i + 1 + (kind == "annotation"))):
            return None
        i += 1 + (kind == "annotation")
        name = self.at(i)
        fqn = f"{outer}.{name}" if outer else f"{self.package}.{name}" if self.package else name
        plain = [n.rpartition(".")[2] for n, _ in notes]
        tables = [m[1] for n, text in notes if n.rpartition(".")[2] == "Table" and (m := re.search(r'name\s*=\s*"([^"]+)"', text))]
        self.classes.append({
            "fqn": fqn, "name": name, "kind": kind, "isAbstract": "abstract" in words or kind in ("interface", "annotation"), "isFinal": "final" in words, "isNested": outer is not None,
            "isStatic": "static" in words, "enclosingFqn": outer or "", "isSpringConfig": "Configuration" in plain, "package": self.package, "lineNumber": self.line(start), "annotations": plain,
            "tableName": tables[0] if tables and "Entity" in plain else None,
        })
        ref = lambda k, n: self.refs.append({"from_id": fqn, "kind": k, "raw": n, "enclosing": outer or ""})
        if "Configuration" in plain:
            for n, text in notes:
                if n.rpartition(".")[2] == "Import":
                    for x in re.findall(r"([\w.]+)\.class", text):
                        ref("SPRING_IMPORTS", x)
        i += 1
        if self.at(i) == "<":
            i = self.close(i)
        if kind == "record" and self.at(i) == "(":
            i = self.close(i)
        while self.at(i) not in ("{", ""):
            if self.at(i) in ("extends", "implements", "permits"):
                word = self.at(i)
                names, i = self.type_list(i + 1)
                for n in names if word != "permits" else ():
                    ref("EXTENDS" if word == "extends" else "IMPLEMENTS", n)
            else:
                i += 1
        if not self.at(i):
            return i
        end = self.close(i)
        i += 1
        if kind == "enum":
            while i < end - 1 and self.at(i) != ";":
                i = self.close(i) if self.at(i) in ("(", "{") else i + 1
        while i < end - 1:
            i = max(self._member(i, end - 1, fqn, name, kind, plain), i + 1)
        return end

    def _member(self, i: int, end: int, owner: str, simple: str, kind: str, marks: list[str]) -> int:
        if self.at(i) == ";":
            return i + 1
        start = i
        words, notes, i = self.modifiers(i)
        if self.at(i) == "{":
            return self.close(i)
        nested = self._type(i, words, notes, owner)
        if nested is not None:
            return nested
        if self.at(i) == "<":
            i = self.close(i)
        ctor = self.at(i) == simple and self.at(i + 1) in ("(", "{")
        raw, returns = "", "void"
        if not ctor:
            raw, returns, i = self.type_ref(i)
        name, head = self.at(i), i
        i += 1
        if self.at(i) == "(" or (ctor and self.at(i) == "{"):
            params = []
            if self.at(i) == "(":
                shut = self.close(i)
                params = self._params(i + 1, shut - 1)
                i = shut
            while self.at(i) == "[":
                returns, i = returns + "[]", i + 2
            while i < end and self.at(i) not in ("{", ";"):
                i += 1
            has_body = self.at(i) == "{"
            signature = ",".join(p["erased"] for p in params)
            plain = [n.rpartition(".")[2] for n, _ in notes]
            abstract = "abstract" in words or (kind in ("interface", "annotation") and not has_body and "default" not in words and "static" not in words)
            self.methods.append({
                "id": f"{owner}#{name}({signature})", "name": name, "ownerFqn": owner, "signature": signature, "arity": len(params), "returnType": returns, "isAbstract": abstract, "isStatic": "static" in words,
                "isConstructor": ctor, "visibility": next((w for w in words if w in ("public", "private", "protected")), "package"), "hasOverrideAnnotation": "Override" in plain, "lineNumber": self.line(start),
                "annotations": [{"name": n.rpartition(".")[2], "value": _literal(t)} for n, t in notes], "rawReturn": raw, "params": params, "ownerAnnotations": marks,
            })
            return self.close(i) if has_body else i + 1
        self.fields.append({"ownerFqn": owner, "name": self.at(head), "raw": raw, "annotations": [{"name": n.rpartition(".")[2], "value": _literal(t)} for n, t in notes]})
        while i < end and self.at(i) != ";":
            i = self.close(i) if self.at(i) in ("(", "{", "[") else i + 1
        return i + 1

    def _params(self, i: int, end: int) -> list[dict]:
        out = []
        while i < end:
            _, notes, i = self.modifiers(i)
            raw, erased, i = self.type_ref(i)
            _, _, i = self.modifiers(i)
            if self.at(i) == "...":
                erased, i = erased + "[]", i + 1
            name = self.at(i)
            i += 1
            while i < end and self.at(i) != ",":
                if self.at(i) == "[":
                    erased += "[]"
                i += 1
            i += 1
            if name != "this":
                out.append({"name": name, "raw": raw, "erased": erased, "qualifier": next((_literal(t) for n, t in notes if n.rpartition(".")[2] == "Qualifier"), None)})
        return out


def _literal(text: str) -> str | None:
    m = re.search(r'"([^"]*)"', text)
    return m[1] if m else None
