"""Token ids of whole texts for the files of the ``tokenizers`` library.

The library spends most of its time on what the ids do not need (offsets, masks, copies of
the pre-tokens).  Two kinds of its files are plain rank-ordered merges, so their merges are
handed to ``tiktoken``'s merge loop, whose ids are then mapped back to those of the file:

* byte-level files (``ByteLevel`` with its own pattern): whole texts as they are;
* files with word ends (``</w>``): lower-cased texts in which a blank ends each pre-token.
  The blank stands for the word end: a byte and a blank are the first to merge, which makes
  the byte's symbol at a word end.  Texts of a batch go through one call, with a control
  character between them.  Pre-tokens are told apart by tables of the characters below
  U+0250; a text with any other character is left to the library.

Merging by the rank of the joined bytes is the same as merging by rules only if no two rules
make the same token, which is tested for each file; the ids of a few texts are compared with
the library's, too.  Files that fail either, and all other kinds, are left to the library.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

#: Characters of the joined texts that are split at once.
SPAN = 1 << 20
_MARK, _JOINED = "\x01", "\x02"
#: The merge loop needs a special token; none is ever looked for.
_UNUSED = "\x00\x01\x02"
#: The pattern of the library's ByteLevel pre-tokenizer (fixed value).
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern that files with word ends split by, as far as this module follows it (fixed value).
_WORD_ENDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: An apostrophe that begins a pre-token and takes letters with it.
_SHORTENED = re.compile(r"(?<![^\s\w])(?<!_)'(?:[stmd]|re|ve|ll)")
_SPACE, _LETTER, _DIGIT, _OTHER, _BETWEEN, _ODD = range(6)
_LATIN = 0x250
_SAMPLES = (
    "A few words, 12 numbers & signs... don't we'll it's O'Neil's\nnext line",
    "über die Straße, déjà vu; ¿qué tal? 3.14 -- (a_b) \"q'uote\"",
    "xqzt Wyrdthkq  two  blanks\ttabs\r\nand returns ",
    "",
)


def _kinds() -> np.ndarray:
    """The class of each character below U+0250, and of all others at the end."""
    out = np.full(_LATIN + 1, _ODD, np.uint8)
    for i in range(_LATIN):
        kind = unicodedata.category(chr(i))
        if kind[0] == "L":
            out[i] = _LETTER
        elif kind[0] == "N":
            out[i] = _DIGIT
        elif kind[0] in "PS":
            out[i] = _OTHER
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[ord(_MARK)] = _BETWEEN
    out[ord(_JOINED)] = _LETTER
    return out


_KIND = _kinds()
_NARROW = _KIND[:256].tobytes()


def _bytes_of_signs() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones
    are themselves, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _merge_core(path: str):
    """``(core, id by rank, word ends)`` of a file whose merges tiktoken can follow, else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, splitter, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    end = model.get("end_of_word_suffix") or ""
    if end:
        steps = splitter.get("pretokenizers", [{}, {}])
        known = (
            len(steps) == 2
            and (steps[0].get("pattern") or {}).get("Regex") == _WORD_ENDS
            and steps[0].get("behavior") == "Removed"
            and steps[0].get("invert") is True
            and steps[1].get("type") == "ByteLevel"
            and not (steps[1].get("add_prefix_space") or steps[1].get("use_regex"))
            and [x.get("type") for x in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        )
    else:
        known = normal is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
    if not known:
        return None
    signs, vocab = _bytes_of_signs(), model["vocab"]

    def raw(token: str) -> bytes:
        stem = token.removesuffix(end) if end else token
        return bytes(signs[c] for c in stem) + b" " * (stem != token)

    alphabet = {b: c for c, b in signs.items()}
    ranks = {bytes([b]): b for b in range(256)}
    ids = [vocab.get(alphabet[b], -1) for b in range(256)]
    if end:
        for b in range(256):
            ranks.setdefault(bytes([b]) + b" ", 256 + b)
            ids.append(vocab.get(alphabet[b] + end, -1))
    try:
        for k, pair in enumerate(model["merges"], len(ids)):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            joined = raw(left) + raw(right)
            if joined in ranks:
                return None
            ranks[joined] = k
            ids.append(vocab[left + right])
    except KeyError:
        return None
    pattern = "[^ ]+ " if end else _BYTE_LEVEL
    made = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={_UNUSED: len(ids)})
    return made._core_bpe, np.array(ids, np.int64), bool(end)


class TextEncoder:
    """Ids of texts; ``path`` is a file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.core, self.ids, self.word_ends = _merge_core(path) or (None, None, False)
        if self.core is not None:
            flat, ends = self.encode(_SAMPLES, 0)
            theirs = [self._by_library(t) for t in _SAMPLES]
            if [x[:-1].tolist() for x in np.split(flat, ends[:-1])] != theirs:
                self.core = None

    def _by_library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end_id`` after each, and where each text ends.

        Null and empty texts are the end id alone.
        """
        if self.core is None:
            each = [np.array([*self._by_library(t or ""), end_id], np.uint32) for t in texts]
        elif self.word_ends:
            each = self._by_word_ends(texts, end_id)
        else:
            each = self._whole(texts, end_id)
        ends = np.cumsum([len(x) for x in each], dtype=np.int64)
        return (np.concatenate(each) if each else np.zeros(0, np.uint32)), ends

    def _whole(self, texts, end_id: int) -> list[np.ndarray]:
        run, table, mark = self.core.encode_to_tiktoken_buffer, np.append(self.ids, end_id).astype(np.uint32), np.array([len(self.ids)], np.uint32)
        return [table[np.append(np.frombuffer(run(t, set()), np.uint32), mark) if t else mark] for t in texts]

    def _by_word_ends(self, texts, end_id: int) -> list[np.ndarray]:
        table = self.ids.astype(np.uint32)
        mark = 256 + ord(_MARK)
        table[mark] = end_id
        kept = {k for k, t in enumerate(texts) if t and (_MARK in t or _JOINED in t)}
        whole = [t if t and k not in kept else "" for k, t in enumerate(texts)]
        ranks, odd = self._ranks((_MARK + "\n").join([*whole, ""]).lower())
        ends = np.flatnonzero(ranks == mark) + 1
        each = np.split(table[ranks], ends[:-1]) if len(texts) else []
        for k in odd | kept:
            each[k] = np.array([*self._by_library(texts[k]), end_id], np.uint32)
        return each

    def _ranks(self, joined: str) -> tuple[np.ndarray, set[int]]:
        """Ranks of the joined texts, and the numbers of those with odd characters."""
        if "'" in joined:
            joined = _SHORTENED.sub(lambda m: f" {_JOINED}{m[0][1:]} ", joined)
        out, odd, at, texts = [], set(), 0, 0
        while at < len(joined):
            end = at + SPAN
            if end < len(joined):  # cut after white space; a longer word stays whole
                cut = max(joined.rfind(" ", at, end), joined.rfind("\n", at, end))
                if cut < 0:
                    cut = min((x for x in (joined.find(" ", end), joined.find("\n", end)) if x >= 0), default=len(joined))
                end = cut + 1
            marked, found, count = _ended(joined[at:end])
            odd |= {texts + k for k in found}
            texts += count
            out.append(np.frombuffer(self.core.encode_to_tiktoken_buffer(marked, set()), np.uint32))
            at = end
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), odd


def _ended(part: str) -> tuple[str, list[int], int]:
    """A stretch of lower-cased texts with a blank after each pre-token, the numbers of its
    texts that have odd characters, and how many texts end in it."""
    try:
        kind = np.frombuffer(part.encode("latin-1").translate(_NARROW), np.uint8)
    except UnicodeEncodeError:
        signs = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _KIND[np.minimum(signs, _LATIN)]
    this, ahead = kind[:-1], kind[1:]
    cuts = (np.flatnonzero((this != _SPACE) & (ahead != _SPACE) & ((this != ahead) | (this == _DIGIT))) + 1).tolist()
    between = np.flatnonzero(kind == _BETWEEN)
    odd = np.flatnonzero(kind == _ODD)
    found = np.unique(np.searchsorted(between, odd)).tolist() if len(odd) else []
    plain = part.replace(_JOINED, "'")
    for c in "\t\n\v\f\r":
        plain = plain.replace(c, " ")
    ended = " ".join([plain[i:j] for i, j in zip([0, *cuts], [*cuts, len(plain)])])
    return ended if kind[-1] == _SPACE else ended + " ", found, len(between)


_KEPT: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The encoder of this process, which Spark's reused workers keep from task to task."""
    if path not in _KEPT:
        _KEPT[path] = TextEncoder(path)
    return _KEPT[path]
