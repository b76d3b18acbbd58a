"""Token ids of whole texts, with a memo of text pieces in front of the tokenizers library.

Both supported vocabularies cut a text at white space before any merge, so the
ids of a text are the ids of its pieces in order. Arrow cuts a block of texts
into pieces, its distinct pieces into runs of letters, digits or marks, and
numbers the distinct ones; each worker keeps the ids of those it has met (two
generations, the older one dropped when the younger is full) and asks the
library only for new ones, many at a time. Texts that hold a special-token
string, a white-space character about which Arrow and the library might
disagree, or a run of white space that a cut before a space would split
wrongly, go to the library whole, and so does every text of a vocabulary with
another pre-tokenizer. All ids are those of the library's plain call on the
whole text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in one generation of a worker's memo.
MEMO_ENTRIES = 400_000
#: Bytes of text cut into pieces at a time (one longer text is cut alone).
CUT_BYTES = 8 << 20
#: Pieces whose ids are laid out at a time (those of one longer text at once).
SPREAD_PIECES = 200_000

_ODD_SPACE = r"[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: White space on both sides of a space: cutting before that space would split the run.
_RUN = r"|\s \s|\s $"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"!-&(-/:-@\[-`{-~"
#: Pieces of plain characters only, without an apostrophe: these fall apart further, independent of context.
_PLAIN = f"^ ?[0-9{_LETTER}{_MARK}]+$"
_PARTS = {"words": f"([{_LETTER}]+|[0-9]|[{_MARK}]+)", "lead_space": f"( ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+)"}
_CUT = "\x1f"  # in no piece: it is odd white space


def _mode(spec: dict) -> str | None:
    """How pieces may be cut for this tokenizer file; None: not at all."""
    pre = spec.get("pre_tokenizer") or {}
    norms = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        return "lead_space"
    steps = pre.get("pretokenizers", [])
    if [p.get("type") for p in steps] == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]:
        pattern = steps[0].get("pattern", {}).get("Regex", "")
        if steps[0].get("behavior") == "Removed" and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
            return "words"
    return None


class _Generations:
    """A dict that forgets the entries not used for longest, a whole generation at a time."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


def _spread(ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the flat values of a list array (``ends``: 0 and the end of each list) of the lists ``which`` one after
    another, and the ends of those lists."""
    lengths = np.diff(ends)[which]
    done = np.concatenate([[0], np.cumsum(lengths)])
    return np.repeat(ends[which] - done[:-1], lengths) + np.arange(done[-1]), done


class TokenMemo:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.mode = _mode(spec)
        special = "".join("|(?i:" + re.escape(t["content"]) + ")" for t in spec.get("added_tokens", []) if t["content"])
        self.whole = _ODD_SPACE + special + (_RUN if self.mode == "lead_space" else "")
        self.parts = _Generations(entries)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.code = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(32, 256)}  # how the vocabulary spells bytes

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, parts: list[str]) -> list[bytes]:
        """Ids of parts not met before: runs of plain characters go to the vocabulary's merges, others all the way."""
        found: list[bytes] = [b""] * len(parts)
        merges, code, plain = self.tokenizer.model.tokenize, self.code, re.compile(_PLAIN[1:-1]).fullmatch
        other = []
        for i, part in enumerate(parts):
            if plain(part):
                found[i] = array("I", [t.id for t in merges(part.translate(code))]).tobytes()
            elif part:
                other.append(i)
        for lo in range(0, len(other), 20_000):
            block = other[lo:lo + 20_000]
            got = self.tokenizer.encode([parts[i] for i in block], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(got.ids, dtype="<u4").tobytes()
            ends = (4 * np.searchsorted(np.array(got.word_ids, dtype=np.int64), np.arange(len(block)), side="right")).tolist()
            for i, a, b in zip(block, [0, *ends], ends, strict=False):
                found[i] = raw[a:b]
        return found

    def _known(self, parts: list[str]) -> list[bytes]:
        """Ids of each part."""
        found = list(map(self.parts.get, parts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self._learn([parts[i] for i in missing]), strict=True):
            found[i] = ids
            self.parts.put(parts[i], ids)
        return found

    def _block(self, texts: pa.StringArray) -> Iterator[bytes]:
        """Ids of texts without nulls that may be cut: texts to pieces to parts to ids."""
        cut = pc.ascii_split_whitespace(texts) if self.mode == "words" else pc.split_pattern(texts, " ")
        ends = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values[ends[0]:ends[-1]].dictionary_encode()
        ends, which, names = ends - ends[0], coded.indices.to_numpy(), coded.dictionary
        if self.mode == "lead_space":  # all pieces but a text's first begin with the space that they were cut at
            first = ends[:-1]
            alone = names.take(pa.array(which[first]))
            which = which.copy()
            which[first] = len(names) + np.arange(len(first))
            names = pa.concat_arrays([pc.binary_join_element_wise(" ", names, ""), alone])
        lower = pc.utf8_lower(names) if self.mode == "words" else names
        pieces = pc.if_else(pc.match_substring_regex(names, _PLAIN), pc.replace_substring_regex(lower, _PARTS[self.mode], "\\1" + _CUT), names)
        split = pc.split_pattern(pieces, _CUT)
        parts = split.values.dictionary_encode()
        piece_ends, piece_parts = split.offsets.to_numpy().astype(np.int64), parts.indices.to_numpy()
        ids = self._known(parts.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), "<u4")
        part_ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
        at, names_ends = _spread(part_ends, piece_parts)  # ids of each piece
        flat, piece_ends = flat[at], names_ends[piece_ends]
        lo = 0
        while lo < len(texts):  # some pieces at a time
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SPREAD_PIECES, side="right")) - 1)
            at, done = _spread(piece_ends, which[ends[lo]:ends[hi]])
            raw, own = flat[at].tobytes(), (4 * done[ends[lo:hi + 1] - ends[lo]]).tolist()
            yield from (raw[a:b] for a, b in zip(own, own[1:], strict=False))
            lo = hi

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """Ids of each whole text; null and empty texts have none."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(texts):
            before = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, before + CUT_BYTES, side="right")))
            block = texts[lo:hi]
            if self.mode is None:
                yield from map(self._whole, block.to_pylist())
            else:
                whole = pc.match_substring_regex(block, self.whole)
                cut = self._block(block.filter(pc.invert(whole)))
                for i, alone in enumerate(whole.to_pylist()):
                    yield self._whole(block[i].as_py()) if alone else next(cut)
            lo = hi


_MEMOS: dict[str, TokenMemo] = {}


def memo(path: str) -> TokenMemo:
    """The worker's memo for a tokenizer file, kept between tasks."""
    if path not in _MEMOS:
        _MEMOS[path] = TokenMemo(path)
    return _MEMOS[path]
