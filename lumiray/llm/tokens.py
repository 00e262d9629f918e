"""Token ids of many texts at once, by a byte-level BPE file of the `tokenizers` library.

Most words of a corpus come again and again. The texts are cut into the tokenizer's own pieces in
numpy (its merges never cross them), each distinct piece is encoded by the library once a worker,
and the ids are gathered by the pieces' hashes. The result is the library's, id by id.
"""

from __future__ import annotations

import numpy as np

from lumiray.llm.common import hash_bytes

LETTER, NUMBER, OTHER, BLANK, BORDER = range(5)
#: fixed values: the contractions that byte-level BPE keeps as pieces of their own
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_MOST_PIECES = 600_000
#: byte-level files write each byte as a printable character: itself, or the next free one from 256
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTED)}
_classes: np.ndarray | None = None
_open: dict[tuple[str, bool], PieceTokenizer] = {}
_open_models: dict[str, SegmentTokenizer] = {}
_SPACE = "\u2581"  #: fixed value: how piece models write a space


def _code_point_classes() -> np.ndarray:
    global _classes
    if _classes is None:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        kinds = np.full(0x110001, OTHER, dtype=np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
            for found in regex.finditer(pattern, every):
                a, b = ord(every[found.start()]), ord(every[found.end() - 1]) + 1
                kinds[a:b] = kind
        kinds[0x110000] = BORDER
        _classes = kinds
    return _classes


def pieces(points: np.ndarray) -> np.ndarray:
    """Where pieces start among code points; 0x110000 separates texts and is a piece of its own."""
    kind = _code_point_classes()[points]
    n = len(points)
    starts = np.ones(n + 1, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=starts[1:n])
    starts[:n] |= kind == BORDER
    # of several blanks before a word the last goes its own way; a space joins the word
    word = np.zeros(n + 1, dtype=bool)
    word[:n] = kind <= OTHER
    last_blank = np.flatnonzero((kind == BLANK) & starts[1:] & word[1:])
    starts[last_blank] = True
    joined = last_blank[points[last_blank] == 32] + 1
    starts[joined] = False
    # contractions begin at an apostrophe that neither joins a space nor has others behind it
    for c in CONTRACTIONS:
        size = len(c)
        at = np.flatnonzero((points[: max(0, n - size + 1)] == 39) & starts[: max(0, n - size + 1)])
        for k in range(1, size):
            at = at[points[at + k] == ord(c[k])]
        starts[at + 1] = False
        starts[at + size] = True
    return np.flatnonzero(starts[:n])


class _Cache:
    """Ids of distinct pieces, found by the pieces' hashes."""

    def _forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _learn(self, hashes: np.ndarray, words: list) -> None:
        """Add words that are not there; `hashes` ascend."""
        found = self._ids(words)
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        at = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(size.sum()))])
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.at = np.insert(self.at, place, at)
        self.size = np.insert(self.size, place, size)

    def _gather(self, hashes: np.ndarray, border: np.ndarray, piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many there are up to the end of each. `piece` gives
        the k-th piece; a border has no ids."""
        if len(self.hashes) > _MOST_PIECES:
            self._forget()
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        known = self.hashes[np.minimum(place, len(self.hashes) - 1)] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known & ~border[first])
        if len(new):
            self._learn(distinct[new], [piece(k) for k in first[new]])
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
            size = np.where(border, 0, self.size[place][which])
            at = self.at[place][which]
        else:
            size = at = np.zeros(len(hashes), dtype=np.int64)
        total = np.cumsum(size)
        return self.ids[np.repeat(at - (total - size), size) + np.arange(total[-1])], total


class PieceTokenizer(_Cache):
    """Strings of added tokens in a text are ordinary text; with `special` they are those tokens, as the library has it
    by default, which then encodes the few texts that hold one."""

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.default = Tokenizer.from_file(path) if special else None
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()] if special else []
        self._forget()

    def _ids(self, words: list[str]) -> list[list[int]]:
        merge = self.library.model.tokenize
        return [[t.id for t in merge(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(_ALPHABET))] for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not texts:
            return []
        marked = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        if marked:
            found = dict(zip(marked, self.default.encode_batch([texts[k] for k in marked], add_special_tokens=False), strict=True))
            rest = iter(self._encode([t for k, t in enumerate(texts) if k not in found]))
            return [np.array(found[k].ids, dtype=np.uint32) if k in found else next(rest) for k in range(len(texts))]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        joined = "".join(t + "\0" for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        points[ends - 1] = 0x110000
        starts = pieces(points)
        stops = np.append(starts[1:], len(points))
        hashes = hash_bytes(points, starts, stops)
        border = points[starts] == 0x110000
        ids, total = self._gather(hashes, border, lambda k: joined[starts[k] : stops[k]])
        return np.split(ids, total[np.flatnonzero(border)][:-1])


def piece_tokenizer(path: str, special: bool = False) -> PieceTokenizer:
    """One for each file and worker."""
    if (path, special) not in _open:
        _open[path, special] = PieceTokenizer(path, special)
    return _open[path, special]


def byte_entries(path: str) -> np.ndarray:
    """The bytes of each id of a byte-level file."""
    written = {c: b for b, c in _ALPHABET.items()}
    names = piece_tokenizer(path).library.get_vocab(with_added_tokens=True)
    out = np.full(max(names.values(), default=-1) + 1, b"", dtype=object)
    for name, k in names.items():
        out[k] = bytes(written[ord(c)] for c in name) if all(ord(c) in written for c in name) else name.encode()
    return out


class SegmentTokenizer(_Cache):
    """Ids by a model of the `sentencepiece` library. No entry of such a model holds a space behind another
    character, so that its merges never cross the place before a run of spaces; each distinct segment between
    those places is encoded once a worker. A model with such entries gets whole texts."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.whole = any(_SPACE in name.lstrip(_SPACE) for name in names)
        self.space = self.library.piece_to_id(_SPACE)
        self._forget()

    def entries(self) -> np.ndarray:
        """The bytes of each id."""
        out = np.full(self.library.get_piece_size(), b"", dtype=object)
        for k in range(len(out)):
            name = self.library.id_to_piece(k)
            out[k] = bytes([int(name[3:5], 16)]) if self.library.is_byte(k) else name.replace(_SPACE, " ").encode()
        return out

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        # the library adds the first space by itself, but gives nothing for an empty text
        found = self.library.encode([w[1:].decode("utf-8", "surrogatepass") for w in words], num_threads=1)
        return [ids if len(w) > 1 else [self.space] for w, ids in zip(words, found, strict=True)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text in UTF-8. Texts begin with the space that the model adds."""
        if not texts:
            return []
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        stops = np.cumsum([len(t) for t in texts])
        begins = np.zeros(len(data), dtype=bool)
        begins[np.append(0, stops[:-1])] = True
        if not self.whole:
            begins[1:] |= (data[1:] == 32) & (data[:-1] != 32)
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        raw = data.tobytes()
        ids, total = self._gather(hash_bytes(data, starts, ends), np.zeros(len(starts), dtype=bool), lambda k: raw[starts[k] : ends[k]])
        return np.split(ids, total[np.searchsorted(ends, stops)][:-1])


def segment_tokenizer(path: str) -> SegmentTokenizer:
    """One for each file and worker."""
    if path not in _open_models:
        _open_models[path] = SegmentTokenizer(path)
    return _open_models[path]
