"""A Markdown subset as rows: nodes, blocks, links, diagnostics, and the addressable render with byte ranges.

Supported: ATX and setext headings, paragraphs, fenced and indented code, bullet and ordered
lists with nesting, pipe tables, rules; emphasis, strong, code spans, links, autolinks, breaks.
Quotes, HTML, footnotes, task items, images, strike-through and wiki links stay as raw text
with a diagnostic.  A complete bullet list whose items begin with code terms and a delimiter becomes
addressable entries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from docloom.schema import MAX_MARKDOWN_DEPTH, RESERVED_IDS

#: Marks of a quick-reference preface, in whatever namespace.
TLDR_START, TLDR_END = re.compile(r"<!--\s*[a-z]+:tldr:start\s*-->"), re.compile(r"<!--\s*[a-z]+:tldr:end\s*-->")

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_BULLET = re.compile(r"^( {0,3})([-+*])([ \t]+|$)(.*)$")
_ORDERED = re.compile(r"^( {0,3})(\d{1,9})([.)])([ \t]+|$)(.*)$")
_SEPARATOR = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_EXPLICIT = re.compile(r"[ \t]*\{#([^\s{}]+)\}[ \t]*$")
_INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<hard>\\\n| {2,}\n)|(?P<soft>\n)|(?P<code>(?P<tick>`+)(?!`)(?P<inner>.+?)(?<!`)(?P=tick)(?!`))"
    r"|(?P<image>!\[[^\]]*\]\([^)]*\))|(?P<wiki>\[\[[^\]]+\]\])|(?P<foot>\[\^[^\]]+\])|(?P<link>\[(?P<label>(?:[^\[\]]|\[[^\]]*\])*)\]\(\s*(?P<dest><[^>]*>|[^\s()]*(?:\([^)]*\)[^\s()]*)*)(?:\s+(?P<title>\"[^\"]*\"|'[^']*'))?\s*\))"
    r"|(?P<auto><(?P<uri>[a-zA-Z][a-zA-Z0-9+.-]+:[^\s<>]*|[^\s<>@]+@[^\s<>]+)>)|(?P<html></?[a-zA-Z][^>]*>|<!--.*?-->)|(?P<strike>~~[^~]+~~)"
    r"|(?P<strong>(?P<sm>\*\*|__)(?=\S)(?P<sv>.+?)(?<=\S)(?P=sm))|(?P<em>(?P<emm>[*_])(?=\S)(?P<ev>(?:(?!(?P=emm)).)+?)(?<=\S)(?P=emm)(?![a-zA-Z0-9]))",
    re.S,
)


@dataclass
class Node:
    kind: str
    path: str
    id: str
    title: str
    level: int = 0
    parent_path: str | None = None
    role: str | None = None
    case_policy: str | None = None
    names: list[str] = field(default_factory=list)


@dataclass
class Block:
    type: str
    owner: str
    text: str
    language: str | None = None
    items: list[str] = field(default_factory=list)
    ordered: bool = False
    start: int = 1
    compact: bool = True
    rows: list[list[str]] = field(default_factory=list)
    entries: list[Node] = field(default_factory=list)


@dataclass
class Parsed:
    title: str | None
    nodes: list[Node]
    blocks: list[Block]
    links: list[dict]
    diagnostics: list[dict]
    tldr: str | None = None


def mask_controls(source: str) -> tuple[str, list[dict]]:
    """Byte-order marks and controls become blanks of the same length in bytes."""
    found = []
    if source.startswith("﻿"):
        found.append({"level": "warning", "code": "markdown.byte-order-mark", "message": "byte-order mark masked"})
        source = "   " + source[1:]
    masked = "".join(" " * len(c.encode()) if (ord(c) < 32 and c not in "\t\n\r") or 127 <= ord(c) < 160 else c for c in source)
    if masked != source:
        found.append({"level": "warning", "code": "markdown.control-characters", "message": "control characters masked"})
    return masked, found


def slug(title: str, keep: str = "_") -> str:
    out = "".join(c.lower() if c.isalnum() or c in keep else "-" for c in title)
    return re.sub(r"-+", "-", out).strip("-")


class Ids:
    """Unique ids; reserved selectors get a suffix."""

    def __init__(self) -> None:
        self.used: set[str] = set(RESERVED_IDS)

    def take(self, wanted: str, reserved_suffix: str = "-section") -> str:
        base = wanted + reserved_suffix if wanted in RESERVED_IDS else wanted
        out, n = base, 2
        while out in self.used:
            out, n = f"{base}-{n}", n + 1
        self.used.add(out)
        return out


def classify_link(dest: str) -> dict:
    if dest.startswith("#"):
        return {"kind": "section", "target_id": dest[1:]}
    if dest.lower().startswith("mailto:"):
        return {"kind": "email", "address": dest[7:]}
    path, _, fragment = dest.partition("#")
    relative = path.lower().endswith((".md", ".markdown")) and not re.search(r"[\\?\x00-\x1f]|^[a-zA-Z][a-zA-Z0-9+.-]*:", path) and not path.startswith("/")
    if relative:
        return {"kind": "document", "name": re.sub(r"\.(md|markdown)$", "", path, flags=re.I), "fragment": fragment or None}
    return {"kind": "external", "uri": dest}


class _Inline:
    """Inline text: what is shown, and the links and diagnostics met."""

    def __init__(self, parsed: Parsed, owner: str) -> None:
        self.parsed, self.owner = parsed, owner

    def plain(self, text: str) -> str:
        return re.sub(_INLINE, self._shown, text)

    def _unsupported(self, raw: str, what: str) -> str:
        self.parsed.diagnostics.append({"level": "unsupported", "code": "markdown.unsupported", "message": what})
        return raw

    def _shown(self, m: re.Match) -> str:
        if m["escape"]:
            return m["escape"][1]
        if m["hard"]:
            return "\n"
        if m["soft"]:
            return " "
        if m["code"]:
            inner = m["inner"].replace("\n", " ")
            return inner[1:-1] if len(inner) > 2 and inner[0] == inner[-1] == " " and inner.strip() else inner
        if m["link"]:
            dest = m["dest"].strip("<>")
            label = self.plain(m["label"])
            self.parsed.links.append({"owner": self.owner, "label": label, "title": (m["title"] or "")[1:-1] or None, **classify_link(dest)})
            return label
        if m["auto"]:
            uri = m["uri"]
            target = {"kind": "external", "uri": uri} if ":" in uri else {"kind": "email", "address": uri}
            self.parsed.links.append({"owner": self.owner, "label": uri, "title": None, **target})
            return uri
        if m["strong"]:
            return self.plain(m["sv"])
        if m["em"]:
            return self.plain(m["ev"])
        return self._unsupported(m[0], m.lastgroup or "inline")


_TERM = re.compile(r"\s*`([^`]+)`")
_ALIAS = re.compile(r"\s*(?:,|/|\||\bor\b)\s*(?=`)")
_DELIMITER = re.compile(r"\s*(?::|—|–)\s*")


def entry_names(terms: list[str], role: str | None) -> tuple[str, list[str]] | None:
    """Role and names of an entry's code terms; None if they are no names of one role."""
    names, roles = [], set()
    for term in terms:
        word = term.split()[0].split("=")[0] if term.split() else ""
        if re.fullmatch(r"--?[A-Za-z0-9?][A-Za-z0-9_.?-]*|--?[A-Za-z0-9]|\+[A-Za-z0-9][\w-]*|/[A-Za-z0-9?]+", word) and not re.search(r"\.\.|\.$", word):
            roles.add("option")
        elif re.fullmatch(r"\$(?:env|ENV):[A-Za-z_]\w*|[A-Z_][A-Z0-9_]+", word):
            roles.add("environment-variable")
        elif re.fullmatch(r"\$(?:[A-Za-z_]\w*|[?$^])", word):
            roles.add("variable")
        elif role == "command" and re.fullmatch(r"[A-Za-z0-9][\w.+-]*", word):
            roles.add("command")
        else:
            return None
        names.append(word)
    if len(roles) != 1 or role is not None and roles != {role}:
        return None
    return roles.pop(), list(dict.fromkeys(names))


def item_entry(item: str, role: str | None) -> tuple[str, list[str], str] | None:
    """(role, names, description) of a list item that declares an entry."""
    first, _, rest = item.partition("\n\n")
    terms, at = [], 0
    while (m := _TERM.match(first, at)) is not None:
        terms.append(m[1])
        at = m.end()
        sep = _ALIAS.match(first, at)
        if not sep:
            break
        at = sep.end()
    delimiter = _DELIMITER.match(first, at) if terms else None
    if delimiter is None or not (first[delimiter.end() :].strip() or rest.strip()):
        return None
    found = entry_names(terms, role)
    return None if found is None else (*found, (first[delimiter.end() :] + ("\n\n" + rest if rest else "")).strip())


def _entry_slug(name: str) -> str:
    bare = name.lstrip("-/")
    return slug("help" if bare == "?" else bare) or "entry"


class _Parser:
    def __init__(self, parsed: Parsed) -> None:
        self.parsed, self.ids, self.owner = parsed, Ids(), "root"
        self.stack: list[Node] = []
        self.counts: dict[str, int] = {}
        self.entries: dict[str, int] = {}
        self.declared: tuple[str, str] | None = None
        self.titled = False

    def heading(self, level: int, raw: str) -> None:
        explicit = _EXPLICIT.search(raw)
        text = _Inline(self.parsed, self.owner).plain(raw[: explicit.start()] if explicit else raw).strip()
        if not text:
            self.parsed.diagnostics.append({"level": "warning", "code": "markdown.empty-heading", "message": "a heading without text"})
            return
        if level == 1 and not self.titled and not self.stack and self.parsed.title is None:
            self.parsed.title, self.titled = text, True
            return
        self.titled = True
        while self.stack and self.stack[-1].level >= level:
            self.stack.pop()
        parent = self.stack[-1].path if self.stack else ""
        self.counts[parent] = self.counts.get(parent, 0) + 1
        path = f"{parent}.{self.counts[parent]}" if parent else str(self.counts[parent])
        node = Node("document-section", path, self.ids.take(explicit[1] if explicit else slug(text) or "section"), text, level, parent or None)
        self.stack.append(node)
        self.parsed.nodes.append(node)
        self.owner = path

    def add(self, block: Block) -> None:
        self.parsed.blocks.append(block)

    def unsupported(self, lines: list[str], what: str) -> None:
        self.parsed.diagnostics.append({"level": "unsupported", "code": "markdown.unsupported", "message": what})
        self.add(Block("unsupported", self.owner, "\n".join(lines)))

    def list_block(self, items: list[str], ordered: bool, start: int, compact: bool) -> None:
        declared, self.declared = self.declared, None
        role = declared[0] if declared else None
        block = Block("list", self.owner, "", items=items, ordered=ordered, start=start, compact=compact)
        if any(re.match(r"\[[ xX]\] ", i) for i in items):
            self.unsupported([f"- {i}" for i in items], "task list")
            return
        found = [item_entry(i, role) for i in items] if not ordered else []
        if found and all(f is not None for f in found) and len({f[0] for f in found}) == 1:
            block.type = "definition-list"
            for kind, names, _ in found:
                n = self.entries[self.owner] = self.entries.get(self.owner, 0) + 1
                policy = declared[1] if declared else "sensitive"
                id_ = self.ids.take(f"{kind}-{_entry_slug(names[0])}", "")
                node = Node("document-entry", f"{self.owner}/e{n}", id_, ", ".join(names), 0, self.owner, kind, policy, names)
                block.entries.append(node)
                self.parsed.nodes.append(node)
            block.items = [f[2] for f in found]
        elif declared:
            for f in found:
                if f is None:
                    self.parsed.diagnostics.append({"level": "warning", "code": "markdown.semantic-entry.missing-leading-code", "message": "an item is no entry"})
        self.add(block)

    def run(self, lines: list[str], depth: int = 0) -> None:
        i, n = 0, len(lines)
        while i < n:
            line = lines[i]
            if not line.strip():
                i += 1
                continue
            if m := _ATX.match(line):
                self.heading(len(m[1]), m[2] or "")
                i += 1
                continue
            if m := _FENCE.match(line):
                stop, body = i + 1, []
                while stop < n and not re.match(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$", lines[stop]):
                    body.append(lines[stop][min(len(m[1]), len(lines[stop]) - len(lines[stop].lstrip(" "))) :])
                    stop += 1
                words = m[3].split()
                self.add(Block("preformatted", self.owner, "\n".join(body), language=words[0] if words else None))
                i = stop + 1
                continue
            if line.startswith(("    ", "\t")):
                stop = i
                while stop < n and (lines[stop].startswith(("    ", "\t")) or not lines[stop].strip()):
                    stop += 1
                body = [x[1:] if x.startswith("\t") else x[4:] for x in lines[i:stop]]
                while body and not body[-1].strip():
                    body.pop()
                self.add(Block("preformatted", self.owner, "\n".join(body)))
                i = stop
                continue
            if m := re.match(r"^\s*<!--\s*[a-z]+:entries\s+(.*?)-->\s*$", line):
                found = dict(re.findall(r"(\w+)=(\S+)", m[1]))
                ok = found.get("role") in ("option", "command", "environment", "environment-variable", "variable") and found.get("case") in ("sensitive", "insensitive")
                if ok:
                    self.declared = (found["role"].replace("environment-variable", "environment").replace("environment", "environment-variable"), found["case"])
                else:
                    self.parsed.diagnostics.append({"level": "warning", "code": "markdown.semantic-entry-list", "message": "an entry directive needs role and case"})
                i += 1
                continue
            if _RULE.match(line):
                self.add(Block("thematic-break", self.owner, ""))
                i += 1
                continue
            if re.match(r"^ {0,3}>", line):
                stop = i
                while stop < n and lines[stop].strip() and (re.match(r"^ {0,3}>", lines[stop]) or stop > i):
                    stop += 1
                self.unsupported(lines[i:stop], "block quote")
                i = stop
                continue
            if re.match(r"^ {0,3}(?:<[a-zA-Z/!?]|\[\^[^\]]+\]:)", line):
                stop = i
                while stop < n and lines[stop].strip():
                    stop += 1
                self.unsupported(lines[i:stop], "HTML or footnote")
                i = stop
                continue
            bullet, ordered = _BULLET.match(line), _ORDERED.match(line)
            if bullet or ordered:
                i = self._list(lines, i, depth)
                continue
            if "|" in line and i + 1 < n and _SEPARATOR.match(lines[i + 1]) and "-" in lines[i + 1] and "|" in lines[i + 1] + line:
                cells = lambda x: [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", x.strip().removeprefix("|").removesuffix("|"))]
                head = cells(line)
                if len(cells(lines[i + 1])) == len(head):
                    stop, body = i + 2, [head]
                    while stop < n and lines[stop].strip() and "|" in lines[stop]:
                        row = cells(lines[stop])
                        body.append((row + [""] * len(head))[: len(head)])
                        stop += 1
                    shown = _Inline(self.parsed, self.owner)
                    self.add(Block("table", self.owner, "", rows=[[shown.plain(c) for c in r] for r in body]))
                    i = stop
                    continue
            stop = i
            while stop < n and lines[stop].strip() and not (stop > i and (_ATX.match(lines[stop]) or _FENCE.match(lines[stop]) or _RULE.match(lines[stop]) and not re.match(r"^ {0,3}-+[ \t]*$", lines[stop]) or _BULLET.match(lines[stop]) and _BULLET.match(lines[stop])[4] or re.match(r"^ {0,3}>", lines[stop]) or re.match(r"^ {0,3}(?:=+|-+)[ \t]*$", lines[stop]))):
                stop += 1
            if stop < n and stop > i and (m := re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[stop])):
                self.heading(1 if m[1][0] == "=" else 2, "\n".join(x.strip() for x in lines[i:stop]))
                i = stop + 1
                continue
            text = "\n".join(x.lstrip() for x in lines[i:stop]).rstrip()
            self.add(Block("paragraph", self.owner, text))
            i = max(stop, i + 1)

    def _list(self, lines: list[str], i: int, depth: int) -> int:
        n, items, blank_inside = len(lines), [], False
        first_bullet, first_ordered = _BULLET.match(lines[i]), _ORDERED.match(lines[i])
        mark = first_bullet[2] if first_bullet else first_ordered[3]
        start = int(first_ordered[2]) if first_ordered and not first_bullet else 1
        current: list[str] | None = None
        indent = 0
        while i < n:
            line = lines[i]
            m = _BULLET.match(line) if first_bullet else _ORDERED.match(line)
            own = m is not None and (m[2] if first_bullet else m[3]) == mark and not _RULE.match(line)
            if own and (current is None or len(m[1]) < indent):
                if current is not None:
                    items.append("\n".join(current).rstrip())
                head = line[: m.start(4)] if first_bullet else line[: m.start(5)]
                gap = m[3] if first_bullet else m[4]
                indent = len(head) if len(gap) <= 4 else len(head) - len(gap) + 1
                current = [line[len(head) :]]
            elif not line.strip():
                if i + 1 < n and lines[i + 1].strip() and (lines[i + 1].startswith(" " * indent) or (_BULLET if first_bullet else _ORDERED).match(lines[i + 1])):
                    blank_inside = True
                    current.append("")
                else:
                    i += 1
                    break
            elif line.startswith(" " * indent):
                current.append(line[indent:])
            elif current and current[-1].strip() and not (_ATX.match(line) or _FENCE.match(line) or _BULLET.match(line) or _ORDERED.match(line) or re.match(r"^ {0,3}>", line)):
                current.append(line.strip())
            else:
                break
            i += 1
        items.append("\n".join(current or []).rstrip())
        if depth >= MAX_MARKDOWN_DEPTH:
            self.unsupported(items, "nesting")
        else:
            self.list_block(items, not first_bullet, start, not blank_inside)
        return i


def parse(source: str) -> Parsed:
    """All rows of one document; never raises for Markdown, however broken."""
    source, diagnostics = mask_controls(source)
    parsed = Parsed(None, [], [], [], diagnostics)
    stripped = source.lstrip()
    if start := TLDR_START.match(stripped):
        if end := TLDR_END.search(stripped, start.end()):
            parsed.tldr, source = stripped[start.end() : end.start()].strip("\n"), stripped[end.end() :]
        else:
            parsed.diagnostics.append({"level": "error", "code": "TldrDirective", "message": "the quick reference does not end"})
    parser = _Parser(parsed)
    parser.run(source.replace("\r\n", "\n").split("\n"))
    for block in parsed.blocks:
        if block.type in ("paragraph", "list", "definition-list"):
            shown = _Inline(parsed, block.owner)
            block.text = shown.plain(block.text)
            block.items = [shown.plain(x) for x in block.items]
    if any(b.owner == "root" for b in parsed.blocks):
        parsed.nodes.insert(0, Node("document-root", "root", "document-overview", parsed.title or "", 0, None))
    ids = {n.id for n in parsed.nodes}
    for link in parsed.links:
        if link["kind"] == "section" and link["target_id"] not in ids and slug(link["target_id"]) in ids:
            link["target_id"] = slug(link["target_id"])
    return parsed


def escape(text: str) -> str:
    return re.sub(r"([\\`*_\[\]<>])", r"\\\1", text)


def code_span(text: str) -> str:
    fence = "`" * (max(map(len, re.findall("`+", text)), default=0) + 1)
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{fence}{pad}{text}{pad}{fence}"


def render_block(block: Block) -> str:
    if block.type == "paragraph":
        return block.text
    if block.type == "preformatted":
        fence = "`" * max(3, max(map(len, re.findall("`+", block.text)), default=0) + 1)
        return f"{fence}{block.language or ''}\n{block.text}\n{fence}"
    if block.type == "table":
        return "```text\n" + "\n".join(" | ".join(r) for r in block.rows) + "\n```"
    if block.type == "list":
        marks = [f"{block.start + k}. " if block.ordered else "- " for k in range(len(block.items))]
        between = "\n" if block.compact else "\n\n"
        return between.join(m + x.replace("\n", "\n" + " " * len(m)) for m, x in zip(marks, block.items))
    if block.type == "definition-list":
        rows = [f'- <a id="{e.id}"></a>{", ".join(map(code_span, e.names))}: ' + x.replace("\n", "\n  ") for e, x in zip(block.entries, block.items)]
        return "\n".join(rows)
    if block.type == "thematic-break":
        return "---"
    return block.text


@dataclass
class Rendered:
    text: str
    ranges: list[tuple[str, int, int]]  # node path, first byte, one past the last


def render(parsed: Parsed, label: str) -> Rendered:
    """One deterministic text with the byte range of every node; that of a section spans its subsections."""
    parts: list[tuple[str | None, str]] = [(None, f"# {parsed.title or label}")]
    sections = [n for n in parsed.nodes if n.kind == "document-section"]
    by_owner: dict[str, list[Block]] = {}
    for b in parsed.blocks:
        by_owner.setdefault(b.owner, []).append(b)
    parts += [("root", render_block(b)) for b in by_owner.get("root", [])]
    for s in sections:
        depth = s.path.count(".") + 2
        parts.append((s.path, f'<a id="{s.id}"></a>\n' + "#" * min(depth, 6) + f" {s.title}"))
        parts += [(s.path, render_block(b)) for b in by_owner.get(s.path, [])]
    at, out, spans = 0, [], {}
    entries = {n.id: n for n in parsed.nodes if n.kind == "document-entry"}
    ranges: list[tuple[str, int, int]] = []
    for owner, text in parts:
        size = len(text.encode())
        if owner is not None:
            first, _ = spans.get(owner, (at, at))
            spans[owner] = (first, at + size)
        for m in re.finditer(r'^- <a id="([^"]+)"></a>', text, re.M):
            if m[1] in entries:
                begin = at + len(text[: m.start()].encode())
                rest = re.search(r"\n(?=- <a id=)", text[m.end() :])
                stop = at + (len(text[: m.end() + rest.start()].encode()) if rest else size)
                ranges.append((entries[m[1]].path, begin, stop))
        out.append(text)
        at += size + 2
    for path, (_, stop) in list(spans.items()):
        while "." in path:
            path = path.rsplit(".", 1)[0]
            if path in spans:
                spans[path] = (spans[path][0], max(stop, spans[path][1]))
    ranges += [(p, a, b) for p, (a, b) in spans.items()]
    return Rendered("\n\n".join(out) + "\n", sorted(ranges, key=lambda r: (r[1], -r[2])))
