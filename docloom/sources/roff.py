"""Manual pages (man and mdoc) as the same rows as Markdown: sections, paragraphs, definitions, tables, links.

Macros that are not known are shown as their text with a diagnostic; nothing is executed
and no file is included.
"""

from __future__ import annotations

import re

from docloom.sources.markdown import Block, Ids, Node, Parsed, entry_names, slug

#: Special characters by name (fixed values of mandoc_char(7)).
CHARACTERS = {
    "aq": "'", "dq": '"', "lq": "“", "rq": "”", "oq": "‘", "cq": "’", "bu": "•", "em": "—", "en": "–", "hy": "‐", "mi": "−", "co": "©", "rg": "®", "tm": "™", "de": "°",
    "ti": "~", "ha": "^", "ga": "`", "rs": "\\", "sl": "/", "ba": "|", "lB": "[", "rB": "]", "lC": "{", "rC": "}", "<-": "←", "->": "→", "<=": "≤", ">=": "≥", "!=": "≠", "+-": "±", "mu": "×", "ss": "ß",
    "a:": "ä", "o:": "ö", "u:": "ü", "A:": "Ä", "O:": "Ö", "U:": "Ü", "'e": "é", "`e": "è", "~n": "ñ", ",c": "ç",
}
ENCLOSURES = {"Op": "[]", "Bq": "[]", "Dq": "“”", "Qq": "“”", "Sq": "‘’", "Ql": "‘’", "Pq": "()", "Brq": "{}", "Aq": "<>"}
STRONG = frozenset("Nm Fl Cm Ic Sy B SB".split())
EMPHASIS = frozenset("Ar Pa Em Va Vt Ft Fa I".split())
CODE = frozenset("Li In Dv Er Ev".split())
FONTS = frozenset("BR BI IB IR RB RI".split())
IGNORED = frozenset("Dd Dt Os TH PD ad hy nh ne na fam sp br ft in ti ta nr ds de am ig so tr ie if el Sm An".split())

_ESCAPE = re.compile(r"\\(?:\((..)|\[([^\]]*)\]|[fF](?:\((?:..)|\[[^\]]*\]|.)|s[-+]?\d|[*n](?:\(..|\[[^\]]*\]|.)|[hvwlLDoNbx]'[^']*'|\"[^\n]*|#[^\n]*|(.))", re.S)
_REFERENCE = re.compile(r"([A-Za-z0-9._+:-]{1,256})\(((?:[1-9][A-Za-z0-9]{0,15})|l|n)\)")


def text_of(raw: str) -> str:
    """Text of a line: escapes become characters, fonts and motions go."""

    def one(m: re.Match) -> str:
        if m[1] is not None:
            return CHARACTERS.get(m[1], m[1])
        if m[2] is not None:
            name = m[2]
            if u := re.fullmatch(r"u([0-9A-Fa-f]{4,6})", name):
                return chr(int(u[1], 16))
            return CHARACTERS.get(name, name)
        if m[3] is None:
            return ""
        return {"-": "-", "e": "\\", " ": " ", "~": " ", "0": " ", "&": "", "c": "", "|": "", "^": "", "%": "", "/": "", ",": "", "p": "\n", "\\": "\\", "'": "´", "`": "`", "t": "\t"}.get(m[3], m[3])

    return _ESCAPE.sub(one, raw)


def arguments(rest: str) -> list[str]:
    """Macro arguments: quoted ones keep blanks, doubled quotes stand for one."""
    return [a[1:].removesuffix('"').replace('""', '"') if a.startswith('"') else a for a in re.findall(r'"(?:[^"]|"")*"?|(?:\\ |\S)+', rest)]


def distance_lines(value: str | None) -> int:
    """Rows of a vertical distance; a missing one is one row."""
    if not value:
        return 1
    m = re.fullmatch(r"([+-]?\d*\.?\d+)([a-zA-Z]?)", value)
    if not m:
        return 1
    scale = {"u": 1 / 40, "c": 6 / 2.54, "i": 6, "p": 1 / 12, "m": 0.6, "n": 0.6, "M": 0.006, "f": 65536 / 40}.get(m[2], 1)
    rows = float(m[1]) * scale
    return next((n for n in range(66) if rows < n + 0.5005), 1)


def mdoc_inline(words: list[str]) -> str:
    """One mdoc line: styled words, enclosures and references as text."""
    out: list[str] = []
    closing: list[str] = []
    glue = False

    def put(word: str, tight: bool = False) -> None:
        nonlocal glue
        if out and not (glue or tight or word in (",", ".", ";", ":", ")", "]", "?", "!")):
            out.append(" ")
        out.append(word)
        glue = word in ("(", "[")

    i = 0
    while i < len(words):
        w = words[i]
        if w in ENCLOSURES:
            put(ENCLOSURES[w][0])
            glue = True
            closing.append(ENCLOSURES[w][1])
        elif w == "Fl":
            flags = 0
            while i < len(words) and words[i] == "Fl":
                flags, i = flags + 1, i + 1
            name = words[i] if i < len(words) and words[i] not in STRONG | EMPHASIS | CODE else ""
            put("-" * flags + text_of(name))
            i += bool(name)
            continue
        elif w == "Xr" and i + 1 < len(words):
            section = words[i + 2] if i + 2 < len(words) and re.fullmatch(r"[0-9]\w*|l|n", words[i + 2]) else None
            put(f"{words[i + 1]}({section})" if section else words[i + 1])
            i += 3 if section else 2
            continue
        elif w == "Ns":
            glue = True
        elif w == "Ap":
            put("'", True)
            glue = True
        elif w == "Nd":
            put("—")
        elif w in STRONG or w in EMPHASIS or w in CODE or w in ("No", "Tn", "Sx", "Lk", "Mt", "Ad", "Pf", "Cd", "Fn", "Xo", "Xc"):
            pass
        else:
            put(text_of(w))
        i += 1
    return "".join(out) + "".join(reversed(closing))


class _Page:
    def __init__(self, parsed: Parsed) -> None:
        self.parsed, self.ids, self.owner = parsed, Ids(), "root"
        self.sections, self.subsections, self.number = 0, 0, 0
        self.lines: list[str] = []
        self.literal = False
        self.item: tuple[str, list[str]] | None = None
        self.items: list[tuple[str, str]] = []
        self.want_term = False
        self.joins_next = False

    def flush(self) -> None:
        text = ("\n" if self.literal else " ").join(x for x in self.lines if x or self.literal).strip("\n" if self.literal else None)
        self.lines = []
        if self.item is not None:
            self.items.append((self.item[0], text))
            self.item = None
        elif text:
            self.end_items()
            self.parsed.blocks.append(Block("preformatted" if self.literal else "paragraph", self.owner, text))

    def end_items(self) -> None:
        if not self.items:
            return
        items, self.items = self.items, []
        bullets = all(len(t) == 1 and not t.isalnum() or t == "o" for t, _ in items)
        if bullets:
            self.parsed.blocks.append(Block("list", self.owner, "", items=[d for _, d in items]))
            return
        block = Block("definition-list", self.owner, "", items=[d for _, d in items])
        for term, _ in items:
            options = re.findall(r"(?<![\w-])(--?[A-Za-z0-9?][\w.?-]*)", term)
            found = entry_names(options, "option") if options else None
            role, names = found or ("command", [term])
            count = sum(len(b.entries) for b in self.parsed.blocks if b.owner == self.owner) + len(block.entries) + 1
            node = Node("document-entry", f"{self.owner}/e{count}", self.ids.take(f"{role}-{slug(names[0].lstrip('-')) or 'entry'}", ""), term, 0, self.owner, role, "sensitive", names)
            block.entries.append(node)
            self.parsed.nodes.append(node)
        self.parsed.blocks.append(block)

    def section(self, title: str, sub: bool) -> None:
        self.flush()
        self.end_items()
        self.number += 1
        if sub and self.sections:
            self.subsections += 1
            path, parent = f"{self.sections}.{self.subsections}", str(self.sections)
        else:
            self.sections += 1
            self.subsections = 0
            path, parent = str(self.sections), None
        self.owner = path
        self.parsed.nodes.append(Node("document-section", path, f"{slug(title, '') or 'section'}-{self.number}", title, 2 if parent is None else 3, parent))

    def text(self, line: str) -> None:
        if self.want_term:
            self.want_term = False
            term = line
            if self.joins_next and self.items and not self.items[-1][1]:
                term = f"{self.items.pop()[0]}, {line}"
            self.joins_next = False
            self.item = (term, [])
        else:
            self.lines.append(line)


def parse(source: str) -> Parsed:
    """Rows of one page; root content outside sections is kept."""
    masked = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", source)
    parsed = Parsed(None, [], [], [], [{"level": "warning", "code": "manual.control-characters", "message": "control characters masked"}] if masked != source else [])
    page = _Page(parsed)
    table: list[list[str]] | None = None
    equation: list[str] | None = None
    mdoc = bool(re.search(r"^\.Dd\b", masked, re.M))
    unknown: set[str] = set()
    for raw in masked.replace("\r\n", "\n").split("\n"):
        if equation is not None:
            if re.match(r"^[.']\s*EN\b", raw):
                parsed.blocks.append(Block("equation", page.owner, "\n".join(equation)))
                equation = None
            else:
                equation.append(raw)
            continue
        if table is not None:
            if re.match(r"^[.']\s*TE\b", raw):
                body = [r for r in table if r]
                start = next((k for k, r in enumerate(body) if r[-1].rstrip().endswith(".")), -1) + 1
                parsed.blocks.append(Block("table", page.owner, "", rows=[[text_of(c) for c in r] for r in body[start:] if r not in (["_"], ["="])]))
                table = None
            elif not raw.startswith("."):
                table.append(raw.split("\t") if raw else [])
            continue
        if re.match(r"^[.']\s*\\[\"#]|^\\\"", raw):
            continue
        if not raw.startswith((".", "'")):
            if raw.strip() or page.literal:
                page.text(text_of(raw) if page.literal else text_of(raw).strip())
            else:
                page.flush()
            continue
        words = raw[1:].strip().split(None, 1)
        if not words:
            continue
        name, rest = words[0], words[1] if len(words) > 1 else ""
        args = arguments(rest)
        shown = " ".join(map(text_of, args))
        if name in ("TH", "Dt"):
            parsed.title = text_of(args[0]) if args else None
        elif name in ("SH", "Sh", "SS", "Ss"):
            page.section(shown, name in ("SS", "Ss"))
        elif name in ("PP", "P", "LP", "HP", "Pp", "RS", "RE", "Bd", "Ed", "D1", "Dl"):
            page.flush()
            if name == "Bd" and any(a in ("-literal", "-unfilled") for a in args):
                page.literal = True
            elif name == "Ed":
                page.literal = False
            elif name in ("D1", "Dl"):
                page.text(mdoc_inline(args))
                page.flush()
        elif name in ("TP", "TQ"):
            page.flush()
            page.want_term, page.joins_next = True, name == "TQ"
        elif name == "IP":
            page.flush()
            if args:
                page.item = (text_of(args[0]), [])
        elif name in ("nf", "EX"):
            page.flush()
            page.literal = True
        elif name in ("fi", "EE"):
            page.flush()
            page.literal = False
        elif name == "It":
            page.flush()
            page.item = (mdoc_inline(args) or "•", [])
        elif name in ("Bl", "El"):
            page.flush()
            page.end_items()
        elif name == "TS":
            page.flush()
            page.end_items()
            table = []
        elif name == "EQ":
            page.flush()
            page.end_items()
            equation = []
        elif name in FONTS:
            page.text("".join(map(text_of, args)))
        elif name in ("UR", "MT"):
            parsed.links.append({"owner": page.owner, "label": shown, "title": None, **({"kind": "external", "uri": shown} if name == "UR" else {"kind": "email", "address": shown})})
        elif name == "MR" and len(args) > 1:
            page.text(f"{args[0]}({args[1]}){args[2] if len(args) > 2 else ''}")
        elif name in ("B", "I", "SB", "SM") and not mdoc:
            page.text(shown)
        elif mdoc and (name in STRONG | EMPHASIS | CODE or name in ENCLOSURES or name in ("Xr", "Nd", "No", "Sx", "Lk", "Mt", "Fn", "Cd")):
            page.text(mdoc_inline([name, *args]))
        elif name not in IGNORED and not name.startswith("\\"):
            if name not in unknown:
                unknown.add(name)
                parsed.diagnostics.append({"level": "unsupported", "code": "manual.unhandled-structural-parts", "message": name})
            if shown:
                page.text(shown)
    page.flush()
    page.end_items()
    if any(b.owner == "root" for b in parsed.blocks):
        parsed.nodes.insert(0, Node("document-root", "root", "document-overview", parsed.title or "", 0, None))
    for block in parsed.blocks:
        for text in [block.text, *block.items]:
            for m in _REFERENCE.finditer(text):
                parsed.links.append({"owner": block.owner, "label": m[0], "title": None, "kind": "manual", "name": m[1], "manual_section": m[2]})
    return parsed


def redirect(source: str) -> str | None:
    """The target of a page that is nothing but one .so request."""
    lines = [x for x in source.split("\n") if x.strip() and not re.match(r"^[.']\s*\\[\"#]", x)]
    m = re.fullmatch(r"[.']\s*so\s+(\S+)\s*", lines[0]) if len(lines) == 1 else None
    return m[1] if m else None
