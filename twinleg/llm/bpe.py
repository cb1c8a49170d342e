"""Byte-level BPE by batched numpy merge rounds.

The symbols of many different words lie in one flat array.  A round looks every adjacent pair up by binary search over sorted
pair keys, finds the lowest rank of each word and merges all its occurrences; words without a known pair leave the array.
Words are cut out by array operations on character classes; each different word is merged once and kept by its hash.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with

#: Code points below this are classified by a table; a text with any other goes word by word through a regular expression.
PLAIN = 0x250
SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)
#: Words kept per worker before the store starts anew, and code points handled at once.
KEEP_WORDS, CHUNK = 1_500_000, 1 << 20
# Fixed values of the format: the split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_OPENED: dict = {}


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def _classes() -> np.ndarray:
    table = np.full(PLAIN + 1, OTHER, np.uint8)
    for c in range(PLAIN):
        kind = unicodedata.category(chr(c))[0]
        table[c] = LETTER if kind == "L" else NUMBER if kind == "N" else SPACE if 9 <= c <= 13 or c in (0x20, 0x85, 0xA0) else OTHER
    table[PLAIN] = EDGE
    return table


CLASSES = _classes()


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd number modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size, r = max(n + 1, 1 << 16), 0xD1342543DE82EF95
        _POWERS[:] = []
        for base in (r, pow(r, -1, 1 << 64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS.append(np.multiply.accumulate(out))
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_CODE_MIX = mixed((np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * _ODD)


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[start:end] for each span (codes below 65536)."""
    up, down = powers(len(codes))
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CODE_MIX[codes] * up[: len(codes)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def ragged(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of values[at[i] : at[i] + size[i]]."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]


class Codec:
    """One vocabulary file.  ``encode`` gives flat ids and their number per text; ``decode`` gives bytes back."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = bool(spec.get("normalizer"))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        names = _byte_names()
        # A missing byte symbol has id -1 and is left out of the result, as the file names no unknown token.
        self.inner = np.array([vocab.get(n, -1) for n in names], np.int64)
        self.final = np.array([vocab.get(n + self.suffix, -1) for n in names], np.int64)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order].astype(np.uint32 if self.size**2 < 1 << 32 else np.int64)
        self.ranks, self.made = order.astype(np.int32), made.astype(np.int32)
        back = {n: b for b, n in enumerate(names)}
        pieces = [b""] * self.size
        for token, i in vocab.items():
            body = token.removesuffix(self.suffix) if self.suffix else token
            pieces[i] = bytes(back[c] for c in body) + (b" " if self.suffix and token.endswith(self.suffix) else b"")
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.slot = np.empty(0, np.int64)
        self.at, self.len, self.ids, self.used, self.words = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(1 << 16, np.int32), 0, 0

    # -- merging ---------------------------------------------------------------------------------------------------------

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each word (none empty)."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inner[raw], np.repeat(np.arange(len(words)), size)
        last = np.cumsum(size) - 1
        sym[last] = self.final[raw[last]]
        none = np.int32(len(self.keys))
        done_sym, done_word = [], []
        if (sym < 0).any():
            keep = sym >= 0
            sym, word = sym[keep], word[keep]
        sym, word = sym.astype(np.int32), word.astype(np.int32)
        rank = np.full(len(sym), none, np.int32)
        look = np.arange(len(sym))
        while len(sym):
            # ranks of the pairs that begin at ``look``; all others are as they were
            look = look[look + 1 < len(sym)]
            same = word[look] == word[look + 1]
            rank[look[~same]] = none
            look = look[same]
            key = sym[look].astype(self.keys.dtype) * self.keys.dtype.type(self.size) + sym[look + 1].astype(self.keys.dtype)
            spot = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank[look] = np.where(self.keys[spot] == key, self.ranks[spot], none)
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[begin, len(sym)])
            least = np.minimum.reduceat(rank, begin)
            least = np.repeat(least, count)
            going = least < none
            # of overlapping occurrences the left one goes first: keep every other one of a run
            where = np.flatnonzero((rank == least) & going)
            if len(where) > 1:
                new_run = np.r_[True, np.diff(where) != 1]
                if not new_run.all():
                    nth = np.arange(len(where)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                    where = where[nth % 2 == 0]
            if not going.all():
                done_sym.append(sym[~going])
                done_word.append(word[~going])
            sym[where] = self.made[rank[where]]
            rank[where] = none
            going[where + 1] = False
            at = (np.cumsum(going) - 1)[where]
            sym, word, rank = sym[going], word[going], rank[going]
            mark = np.zeros(len(sym), bool)
            mark[at] = True
            mark[at[at > 0] - 1] = True
            look = np.flatnonzero(mark)
        if not done_word:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        flat, owner = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return flat[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _slots(self, hashes: np.ndarray, spell) -> np.ndarray:
        """Slots of different words, given by sorted hashes; ``spell(i)`` gives the bytes of one that is new."""
        spot = np.searchsorted(self.known, hashes)
        if len(self.known):
            found = self.known[np.minimum(spot, len(self.known) - 1)] == hashes
        else:
            found = np.zeros(len(hashes), bool)
        new = np.flatnonzero(~found)
        if len(new):
            flat, size = self.merge([spell(i) for i in new.tolist()])
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(self.ids), len(flat)), np.int32)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.at = np.concatenate([self.at, self.used + np.cumsum(size) - size])
            self.len = np.concatenate([self.len, size])
            self.slot = np.insert(self.slot, spot[new], self.words + np.arange(len(new)))
            self.known = np.insert(self.known, spot[new], hashes[new])
            self.used, self.words = self.used + len(flat), self.words + len(new)
        return self.slot[np.searchsorted(self.known, hashes)]

    # -- texts -----------------------------------------------------------------------------------------------------------

    def plain(self, text: str) -> bool:
        """Whether the class table is enough: no contraction, no special token, no code point beyond the table."""
        return "'" not in text and "<|" not in text and (text.isascii() or (np.frombuffer(text.encode("utf-32-le"), np.uint32).max() < PLAIN and (not self.lower or "İ" not in text)))

    def _plain_words(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        whole = chr(PLAIN).join([*texts, ""])  # each text is followed by an edge mark
        if self.lower:
            whole = whole.lower()  # keeps lengths below PLAIN, but for the one letter that plain() refuses
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = CLASSES[codes]
        before, after = np.r_[np.uint8(EDGE), kind[:-1]], np.r_[kind[1:], np.uint8(EDGE)]
        if self.lower:
            start = (kind != before) | (kind == NUMBER)
        else:
            space = kind == SPACE
            blank = np.r_[False, codes[:-1] == 0x20]
            start = ((kind != before) & ~(blank & ~space)) | (space & (after != SPACE) & (after != EDGE))
        start |= (kind == EDGE) | (before == EDGE)
        begin = np.flatnonzero(start)
        end = np.r_[begin[1:], len(codes)]
        own = kind[begin]
        words = own != EDGE
        if self.lower:
            words &= own != SPACE
        owner = np.cumsum(own == EDGE)[words]
        return whole, codes, begin[words], end[words], owner

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole, codes, begin, end, owner = self._plain_words(texts)
        if not len(begin):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        hashes, first, which = np.unique(span_hashes(codes, begin, end), return_index=True, return_inverse=True)
        b, e = begin[first].tolist(), end[first].tolist()
        slot = self._slots(hashes, lambda i: whole[b[i] : e[i]].encode())[which]
        size = self.len[slot]
        flat = ragged(self.ids, self.at[slot], size)
        return flat, np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)[: len(texts)]

    def _encode_words(self, text: str) -> np.ndarray:
        """The exact way for the other texts: special tokens are cut out, then words are found by the split pattern."""
        import regex

        if self.lower:
            raise ValueError("only plain texts")
        out = []
        cut = "|".join(map(regex.escape, self.special))
        for part in regex.split(f"({cut})", text) if cut else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.int32))
                continue
            words = [w.encode() for w in regex.findall(SPLIT, part)]
            if words:
                different = {w: i for i, w in enumerate(dict.fromkeys(words))}
                flat, size = self.merge(list(different))
                which = np.array([different[w] for w in words])
                out.append(ragged(flat, (np.cumsum(size) - size)[which], size[which]))
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; memory is bounded by CHUNK and the longest text."""
        batch, held, total = [], [], 0
        for text in [*texts, None]:
            if text is None or total >= CHUNK:
                plain = [t for t in batch if t is not None]
                flat, size = self._encode_plain(plain) if plain else (None, np.empty(0, np.int64))
                ends = iter(np.split(flat, np.cumsum(size)[:-1]) if plain else ())
                for t, other in zip(batch, held, strict=True):
                    yield next(ends) if t is not None else other
                batch, held, total = [], [], 0
                if self.words > KEEP_WORDS:
                    self._forget()
            if text is not None:
                ok = self.plain(text)
                batch.append(text if ok else None)
                held.append(None if ok else self.other(text))
                total += len(text)

    def other(self, text: str) -> np.ndarray:
        return self._encode_words(text)

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.piece_bytes, self.piece_at[ids], self.piece_len[ids]).tobytes()


class LowerCodec(Codec):
    """A vocabulary with a normalizer: texts beyond the class table go through the tokenizers library."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def other(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)


def codec(path: str) -> Codec:
    """The codec of a file, opened once per worker."""
    if path not in _OPENED:
        with open(path, encoding="utf-8") as f:
            lower = bool(json.load(f).get("normalizer"))
        _OPENED[path] = (LowerCodec if lower else Codec)(path)
    return _OPENED[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of ``text`` (array<int>; null text: empty) under the vocabulary file ``path``.

    Every row is kept with its columns; a column already named ``out`` is replaced.  An empty table stays empty.
    """
    docs = docs.drop(out)
    schema = schema_with(docs, **{out: "array<int>"})

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            ids = list(c.encode(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of ``ids`` (null: empty), as UTF-8 with replacement marks where ids don't form whole characters."""
    docs = docs.drop(out)
    schema = schema_with(docs, **{out: "string"})

    def run(batches):
        c = codec(path)
        for b in batches:
            rows = b.column(b.schema.get_field_index(ids)).to_pylist()
            texts = [c.decode(np.array(r or [], np.int64)).decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def digest_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text in one pass, returning digests instead of the ids and texts.

    doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (UTF-8).  Null and empty
    texts have no ids; repeated rows give repeated rows; a null doc_id stays null; no rows give no rows.
    """

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n, one, two = [], [], []
            for ids in c.encode(texts):
                n.append(len(ids))
                one.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back = c.decode(ids)
                try:
                    back.decode()
                except UnicodeDecodeError:
                    back = back.decode("utf-8", "replace").encode()
                two.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
