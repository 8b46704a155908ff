"""Text of the formats: each gives folded text, an offset map, and the structure it has."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.fold import MARKS, fold, words
from . import markdown

_MARK = re.compile(MARKS)
#: Keys of a canvas whose strings are text.
CANVAS_KEYS = frozenset(("text", "label", "file", "url"))
_JSON = re.compile(r'"(?P<body>(?:[^"\\]|\\u.{0,4}|\\.?)*)(?P<close>"?)(?P<colon>[ \t\r\n]*:)?|[^ \t\r\n:"]', re.S)
_RUN = re.compile(r"(?:\\u.{0,4}|\\.?)|([^\\]+)", re.S)
BARRIER = "\x03"


@dataclass
class Document:
    """Offsets are code points into ``text``; ``offset_map`` leads to the raw text, and is
    None where both agree."""

    text: str = ""
    offset_map: list[int] | None = None
    frontmatter: tuple[int, int] | None = None
    headings: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    breaks: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)
    open_task: bool = False

    @property
    def words(self) -> list[str]:
        return words(self.text)

    def with_barriers(self) -> str:
        """The text in which a blank that a phrase may not cross is U+0003."""
        barriers = [*(self.frontmatter or ()), *self.breaks]
        barriers += [x for h in self.headings for x in h[1:3]]
        if not barriers:
            return self.text
        chars = list(self.text)
        for b in barriers:
            for at in (b, b - 1):
                if 0 <= at < len(chars) and chars[at] in (" ", BARRIER):
                    chars[at] = BARRIER
                    break
        return "".join(chars)


def markdown_document(raw: str, created_field: str = "created") -> Document:
    note = markdown.scan(raw, markdown.created_key(created_field))
    chars = [" " if blank else c for c, blank in zip(raw, note.mask)] if any(note.mask) else raw
    if not _MARK.search(raw):
        return Document(fold("".join(chars)), None, note.frontmatter, note.headings, note.breaks, note.tags, note.properties, note.open_task)
    kept = [i for i, c in enumerate(raw) if not _MARK.match(c)]
    to_text, n = [], 0  # raw offset to text offset
    marks = set(range(len(raw))) - set(kept)
    for i in range(len(raw)):
        to_text.append(n)
        n += i not in marks
    to_text.append(n)
    return Document(
        fold("".join(chars[i] for i in kept)),
        [*kept, len(raw)],
        note.frontmatter and tuple(to_text[x] for x in note.frontmatter),
        [(h[0], *(to_text[x] for x in h[1:])) for h in note.headings],
        [to_text[x] for x in note.breaks],
        note.tags,
        note.properties,
        note.open_task,
    )


def compact_document(raw: str, segments: list[tuple[int, int]]) -> Document:
    """Segments in order, one blank between them, where phrases stop."""
    chars: list[str] = []
    offsets: list[int] = []
    breaks: list[int] = []
    for start, end in segments:
        if end <= start:
            continue
        if chars:
            breaks.append(len(chars))
            chars.append(" ")
            offsets.append(start)
        for i in range(start, end):
            if not _MARK.match(raw[i]):
                chars.append(raw[i])
                offsets.append(i)
    return Document(fold("".join(chars)), [*offsets, len(raw)], breaks=breaks)


def canvas_segments(raw: str) -> list[tuple[int, int]]:
    """Literal runs of the string values of the text keys; escapes end a run."""
    out, key = [], ""
    for m in _JSON.finditer(raw):
        if m["body"] is None:
            key = ""
        elif m["colon"] is not None:
            key = m["body"]
        else:
            if key in CANVAS_KEYS:
                base = m.start("body")
                out += [(base + r.start(1), base + r.end(1)) for r in _RUN.finditer(m["body"]) if r[1]]
            key = ""
    return out


def base_segments(raw: str) -> list[tuple[int, int]]:
    """Trimmed lines that are not empty."""
    return [m.span(1) for m in re.finditer(r"^[ \t\r]*([^ \t\r\n](?:[^\n]*[^ \t\r\n])?)[ \t\r]*$", raw, re.M)]


def extract(kind: str, raw: str, created_field: str = "created") -> Document:
    if kind == "canvas":
        return compact_document(raw, canvas_segments(raw))
    if kind == "base":
        return compact_document(raw, base_segments(raw))
    return markdown_document(raw, created_field)
