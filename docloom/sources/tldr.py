"""Quick-reference pages: title, description, examples with placeholders."""

from __future__ import annotations

import re


def command_parts(command: str) -> list[tuple[str, str]]:
    """Text and placeholders of a command; `{{[-s|--long]}}` becomes its long form, escaped braces stay."""
    out: list[tuple[str, str]] = []

    def add(kind: str, value: str) -> None:
        if value:
            if out and out[-1][0] == kind == "text":
                out[-1] = (kind, out[-1][1] + value)
            else:
                out.append((kind, value))

    at = 0
    for m in re.finditer(r"\\\{\\\{(.*?)\\\}\\\}|\{\{(.*?)\}\}(?!\})", command):
        add("text", command[at : m.start()])
        if m[1] is not None:
            add("text", "{{" + m[1] + "}}")
        elif option := re.fullmatch(r"\[(-[^|\]]*)\|(--?[^\]]*)\]", m[2]):
            add("text", option[2])
        else:
            add("placeholder", m[2])
        at = m.end()
    add("text", command[at:])
    return out


def parse(text: str) -> dict:
    """title, description, more_information and examples; a page without a title is refused."""
    title, description, more, examples, pending = None, [], None, [], None
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("# ") and title is None:
            title = s[2:].strip()
        elif s.startswith(">"):
            value = s[1:].strip()
            if m := re.match(r"More information:\s*<?([^>]*?)>?\.?$", value):
                more = m[1]
            elif value:
                description.append(value)
        elif s.startswith("- "):
            pending = s[2:].strip().removesuffix(":")
        elif s.startswith("`") and s.endswith("`") and len(s) > 1 and pending is not None:
            command = s.strip("`").strip()
            examples.append({"description": pending, "command": command, "parts": [{"type": k, "value": v} for k, v in command_parts(command)]})
            pending = None
    if not title:
        raise ValueError("a quick reference needs a title")
    return {"title": title, "description": description, "more_information": more, "examples": examples}


def render(page: dict, community: bool = True) -> str:
    lines = [f"# {page['title']}", "", *[f"{d}" for d in page["description"]]]
    if page.get("more_information"):
        lines.append(f"More information: <{page['more_information']}>")
    for e in page["examples"]:
        lines += ["", f"- {e['description']}:", "", f"  `{''.join(p['value'] if p['type'] == 'text' else '<' + p['value'] + '>' for p in e['parts'])}`"]
    if community:
        lines += ["", "Source: community quick reference"]
    return "\n".join(lines)
