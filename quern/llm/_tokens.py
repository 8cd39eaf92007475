"""Tokenising whole texts with a memo of white-space-delimited chunks.

The public tokenizers used here never join text across ASCII white space: their
normalisers work character by character there and their splitters drop it. So a
text's ids are the ids of its chunks one after another, and a chunk that was
seen before need not be encoded again. ``ChunkEncoder`` checks that premise on
the vocabulary file and falls back to encoding whole texts where it does not hold.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from array import array

import numpy as np

from quern.llm._common import trimmed

#: Chunks in a generation of a Python worker's memo, and the longest one kept. When a
#: generation is full it becomes the old one and the one before goes, except for the
#: chunks met again: memory stays bounded however large the input.
MEMO_CHUNKS = 400_000
MEMO_CHUNK_BYTES = 48
#: Bytes of text encoded at a time, and new chunks joined into one encoder call.
SLAB_BYTES = 5_000_000
JOIN = 256

_encoders: dict = {}


class ChunkEncoder:
    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS, slab_bytes: int = SLAB_BYTES):
        self.memo_chunks, self.slab_bytes = memo_chunks, slab_bytes
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t for t in spec.get("added_tokens") or [] if t.get("special")]
        self.splits = bool(special) and _drops_white_space(spec)
        if self.splits:
            # A special token between chunks marks where each one's ids end.
            self.joined = Tokenizer.from_file(path)
            self.mark, self.mark_id = special[-1]["content"], special[-1]["id"]
            self.marks = [t["content"].encode() for t in special]
            self.model, self.letters = self.plain.model, _byte_letters()
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, text: bytes) -> bytes:
        ids = self.plain.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow string array one after another, and how many each text has; null texts have none."""
        parts = list(self.slabs(texts))
        return np.concatenate([p[1] for p in parts] or [np.zeros(0, "<u4")]), np.concatenate([p[2] for p in parts] or [np.zeros(0, np.int64)])

    def slabs(self, texts):
        """As encode, a bounded lot of texts at a time: (place of the first text, ids, counts)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + self.slab_bytes)))
            some = texts.slice(start, end - start).fill_null("")
            if self.splits:
                # The memo holds no cycles; looking for some in it costs a good part of the time.
                gc.disable()
                ids, n = self._slab(some)
                gc.enable()
            else:
                each = [self._whole(t) if t else b"" for t in some.cast(pa.binary()).to_pylist()]
                ids, n = np.frombuffer(b"".join(each), dtype="<u4"), np.array([len(x) // 4 for x in each], dtype=np.int64)
            yield start, ids, n
            start = end
        trimmed()

    def _slab(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        small = pc.ascii_lower(texts)
        raw = np.frombuffer(small.buffers()[2] or b"", dtype=np.uint8)
        if ((raw == 0xCC) | (raw == 0xCD)).any():
            # Combining marks may compose with small letters only: such texts keep their case here.
            marked = [b"\xcc" in t or b"\xcd" in t for t in texts.cast(pa.binary()).to_pylist()]
            small = pc.if_else(pa.array(marked), texts, small)
        words = pc.ascii_split_whitespace(small)
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        ids = self._chunks(coded.dictionary.cast(pa.binary()).to_pylist())
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(size) - size
        n = size[at]
        ends = np.cumsum(n)
        out = flat[np.repeat(first[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        edge = np.concatenate([[0], ends])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return out, np.diff(edge)

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of different chunks."""
        if len(self.memo) > self.memo_chunks:
            self.old, self.memo = self.memo, {}
        memo = self.memo
        memo[b""] = b""
        have = list(map(memo.get, chunks))
        new = [c for c, x in zip(chunks, have) if x is None]
        if not new:
            return have
        again = {c: x for c, x in zip(new, map(self.old.get, new)) if x is not None}
        memo.update(again)
        new = set(new).difference(again)
        # A last full stop or comma after a letter or digit is a piece of its own.
        ended = [c for c in new if c[-1] in b".," and c[-2:-1].isalnum()]
        found = self._ids([c for c in (new.difference(ended) | {c[:-1] for c in ended} | {b".", b","}) if c not in memo])
        get = lambda c: memo[c] if c in memo else found[c]
        stop = {b"."[0]: get(b"."), b","[0]: get(b",")}
        found.update([(c, get(c[:-1]) + stop[c[-1]]) for c in ended])
        memo.update((c, x) for c, x in found.items() if len(c) <= MEMO_CHUNK_BYTES)
        found.update(again)
        return [found[c] if x is None else x for c, x in zip(chunks, have)]

    def _ids(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        out, rest, tokenize, letters = {}, [], self.model.tokenize, self.letters
        for c in chunks:
            # A chunk of small letters is one piece: its bytes go to the merges as they are.
            if c.isalpha() and c.islower():
                out[c] = array("I", [t.id for t in tokenize(c.decode())]).tobytes()
                continue
            word = c.decode("utf-8", "replace")
            if word.isalpha() and word.lower() == word and unicodedata.is_normalized("NFC", word):
                out[c] = array("I", [t.id for t in tokenize(c.decode("latin-1").translate(letters))]).tobytes()
            else:
                rest.append(c)
        chunks = rest
        for c in [c for c in chunks if any(m in c for m in self.marks)]:
            out[c] = self._whole(c)
        chunks = [c for c in chunks if c not in out]
        joined = [self.mark.join([c.decode("utf-8", "replace") for c in chunks[k : k + JOIN]]) + self.mark for k in range(0, len(chunks), JOIN)]
        at = 0
        for e in self.joined.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.asarray(e.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark_id)
            raw, start = ids.tobytes(), 0
            for end in (ends * 4).tolist():
                out[chunks[at]] = raw[start:end]
                start, at = end + 4, at + 1
        return out


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is visible, else the next free one."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: 256 + k for k, b in enumerate(hidden)}


def _drops_white_space(spec: dict) -> bool:
    """Whether ids of a text are those of its chunks between ASCII white space."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [spec.get("pre_tokenizer") or {}])
    head = parts[0]
    normal = (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {}])
    # Chunks are lower-cased before they are encoded, so the vocabulary must do so itself.
    fixed = any(n.get("type") == "Lowercase" for n in normal) and all(n.get("type") in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for n in normal)
    pattern = (head.get("pattern") or {}).get("Regex", "")
    # Every alternative is made of letters, digits or a class without white space.
    safe = all(re.fullmatch(r"'[a-z]+|\[\\p\{[LN]\}\]\+?|\[\^\\s[^\]]*\]\+", p) for p in pattern.split("|"))
    bytewise = len(parts) == 2 and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
    return bool(fixed and bytewise and pattern and safe and head.get("type") == "Split" and head.get("behavior") == "Removed" and head.get("invert"))


def encoder(path: str, memo_chunks: int = MEMO_CHUNKS, slab_bytes: int = SLAB_BYTES) -> ChunkEncoder:
    """The worker's encoder of a vocabulary file, with its memo."""
    key = path, memo_chunks, slab_bytes
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(*key)
    return _encoders[key]
