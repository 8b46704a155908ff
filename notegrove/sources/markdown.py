"""Markdown to searchable text: what is markup is blanked, and structure is noted.

Blanking keeps lengths, so offsets into the result are offsets into the note.  Lines are
classified by a few patterns; inline markup is found by one alternation whose hits are
handled case by case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.dates import unquote
from ..functions.fold import fold, fold_field

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)", re.S)
_QUOTE = re.compile(r" {0,3}>")
_BLANK = re.compile(r"[ \t]*\Z")
_HEADING = re.compile(r" {0,3}(#{1,6})(?=[ \t]|\Z)[ \t]*(.*?)[ \t]*\Z", re.S)
_CLOSING = re.compile(r"(?:\A|[ \t]+)(#+)\Z")
_UNDERLINE = re.compile(r"[ \t]*(?:(=+)|-+)[ \t]*\Z")
_IGNORED = re.compile(
    r"""[ \t]*([-*_])(?:[ \t]*\1){2,}[ \t]*\Z           # a rule
    | (?=[^-]*-)(?=.*[|:])[-|:\ \t]+\Z                   # a table's delimiter row
    | \[(?!\^)[^\]]*\]:[ \t]*[^ \t]+(?:[ \t]*\Z|[ \t]+["'(])  # a link's definition""",
    re.X | re.S,
)
_ITEM = re.compile(r"[ \t]*(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]+|\Z)")
_TASK = re.compile(r"\[[ /?]\](?=[ \t]|\Z)")
_INLINE = re.compile(r"\\|`+|<|!(?=\[)|\[|[*_~=|\]%]|#")
_HTML = re.compile(r"<[A-Za-z/!][^<>]*>")
_TAG = re.compile(r"#((?:[A-Za-z0-9_/-]|[^\x00-\x7f])*(?:[A-Za-z_/-]|[^\x00-\x7f])(?:[A-Za-z0-9_/-]|[^\x00-\x7f])*)")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_KEY = re.compile(r"(?![ \t-])([^:#]+):(.*)", re.S)
_LISTED = re.compile(r"[ \t]*-(?:[ \t]+|\Z)(.*)", re.S)
DEEPEST = 8


@dataclass
class Note:
    """What a scan found; spans are offsets into the raw text."""

    mask: bytearray
    frontmatter: tuple[int, int] | None = None
    headings: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # level, span, span of the text
    breaks: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)
    open_task: bool = False

    def blank(self, start: int, end: int) -> None:
        if end > start:
            self.mask[start:end] = b"\x01" * (end - start)

    def add_tag(self, value: str) -> None:
        tag = fold_field(unquote(value.strip()).strip().lstrip("#"))
        if tag and tag not in self.tags:
            self.tags.append(tag)


def _lines(raw: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in raw.split("\n"):
        out.append((at, at + len(line) - line.endswith("\r")))
        at += len(line) + 1
    return out


def _frontmatter(note: Note, raw: str, lines: list[tuple[int, int]], created_key: str) -> int:
    """Read the block between the fences; the index of the first line after it."""
    text = [raw[a:b].strip(" \t") for a, b in lines]
    if len(lines) < 2 or text[0] != "---":
        return 0
    close = next((i for i, t in enumerate(text) if i and t in ("---", "...")), None)
    if close is None:
        return 0
    note.frontmatter = (0, lines[close][1])
    note.blank(*lines[0])
    note.blank(*lines[close])
    entries: list[tuple[str, list[str] | str]] = []
    for a, b in lines[1:close]:
        line = raw[a:b]
        if _BLANK.match(line):
            continue
        listed, pair = _LISTED.match(line), _KEY.match(line)
        if listed and entries and isinstance(entries[-1][1], list):
            entries[-1][1].append(unquote(listed[1].strip()))
        elif pair:
            value = pair[2].strip()
            entries.append((pair[1].strip(), value or []))
    for key, value in entries:
        name, joined = fold_field(key).strip(), value if isinstance(value, str) else " ".join(value)
        if not name or not value:
            continue
        note.properties[name] = unquote(joined) if name == created_key else fold_field(unquote(joined))
        if name in ("tags", "tag"):
            for tag in filter(None, re.split(r"[, \t\[\]]+", joined)):
                note.add_tag(tag)
    return close + 1


def _bracket(note: Note, view: str, at: int, end: int, depth: int) -> int:
    """Handle the bracket at ``at``; where scanning goes on."""
    if view.find("]", at + 1, end) < 0:
        note.blank(at, at + 1)
        return at + 1
    if view.startswith("[[", at):
        close = view.find("]]", at + 2, end)
        note.blank(at, at + 2)
        if close < 0:
            return at + 2
        note.blank(close, close + 2)
        note.blank(at + 2, view.find("|", at + 2, close) + 1)
        return close + 2
    if view.startswith("[^", at):
        close = view.find("]", at + 2, end)
        after = close + 1 + view.startswith(":", close + 1, end) if close >= 0 else at + 1
        note.blank(at, after)
        return after
    level = 0
    for m in re.compile(r"[\[\]]").finditer(view, at, end):
        level += 1 if m[0] == "[" else -1
        if level == 0:
            close = m.start()
            break
    else:
        note.blank(at, at + 1)
        return at + 1
    note.blank(at, at + 1)
    note.blank(close, close + 1)
    after = close + 1
    if view.startswith("(", after, end):
        level = 0
        for m in re.compile(r"[()]").finditer(view, after, end):
            level += 1 if m[0] == "(" else -1
            if level == 0:
                note.blank(after, m.end())
                after = m.end()
                break
    elif view.startswith("[", after, end) and (last := view.find("]", after + 1, end)) >= 0:
        note.blank(after, last + 1)
        after = last + 1
    if depth < DEEPEST:
        _inline(note, view, at + 1, close, depth + 1)
    return after


def _inline(note: Note, view: str, at: int, end: int, depth: int = 0) -> None:
    """Blank inline markup between ``at`` and ``end``; ``view`` has no markup in comments."""
    while m := _INLINE.search(view, at, end):
        start, at = m.start(), m.end()
        mark = m[0]
        if mark == "[":
            at = _bracket(note, view, start, end, depth)
        elif mark == "\\":
            note.blank(start, at)
            at += 1
        elif mark[0] == "`":
            note.blank(start, at)
            close = re.compile(rf"(?<!`)`{{{len(mark)}}}(?!`)").search(view, at, end)
            if close:
                note.blank(*close.span())
                at = close.end()
        elif mark == "<":
            if tag := _HTML.match(view, start, end):
                note.blank(*tag.span())
                at = tag.end()
        elif mark == "#":
            alone = start == 0 or note.mask[start - 1] or view[start - 1] in " \t\r\n("
            if alone and (tag := _TAG.match(view, start, end)):
                note.blank(start, at)
                note.add_tag(tag[1])
                at = tag.end()
        else:
            note.blank(start, at)


def scan(raw: str, created_key: str = "created") -> Note:
    note = Note(bytearray(len(raw)))
    lines = _lines(raw)
    first = _frontmatter(note, raw, lines, created_key)
    body = lines[first][0] if first < len(lines) else len(raw)
    view = raw[:body] + _COMMENT.sub(lambda m: "\0" * len(m[0]), raw[body:])
    for m in _COMMENT.finditer(raw, body):
        note.blank(*m.span())
    fence: str | None = None
    above: tuple[int, int, int] | None = None  # line start and trimmed text of a paragraph's last line
    for start, end in lines[first:]:
        line = raw[start:end]
        opened = _FENCE.match(line)
        if fence:
            if opened and opened[1][0] == fence[0] and len(opened[1]) >= len(fence) and _BLANK.match(opened[2]):
                note.blank(start, end)
                fence = None
            elif _BLANK.match(line) and start < len(raw):
                note.breaks.append(start)
            continue
        last, above = above, None
        if opened:
            note.blank(start, end)
            fence = opened[1]
            continue
        at = start
        while quote := _QUOTE.match(raw, at, end):
            at = quote.end()
            note.blank(at - 1, at)
        rest = raw[at:end]
        if _BLANK.match(rest):
            if start < len(raw):
                note.breaks.append(start)
            continue
        if heading := _HEADING.match(rest):
            a, b = at + heading.start(2), at + heading.end(2)
            note.blank(at + heading.start(1), at + heading.end(1))
            if closing := _CLOSING.search(heading[2]):
                note.blank(a + closing.start(1), end)
                b = a + closing.start()
            _inline(note, view, a, b)
            note.headings.append((len(heading[1]), start, end, a, b))
            continue
        underline = _UNDERLINE.match(rest) if last else None
        if underline:
            note.blank(at, end)
            note.headings.append((1 if underline[1] else 2, last[0], end, last[1], last[2]))
            continue
        if _IGNORED.match(rest):
            note.blank(at, end)
            continue
        if item := _ITEM.match(rest):
            note.open_task |= _TASK.match(rest, item.end()) is not None
            note.blank(at, at + item.end())
            _inline(note, view, at + item.end(), end)
            continue
        _inline(note, view, at, end)
        text = rest.strip(" \t")
        a = at + len(rest) - len(rest.lstrip(" \t"))
        above = (start, a, a + len(text))
    return note


def created_key(name: str) -> str:
    return fold(name).strip()
