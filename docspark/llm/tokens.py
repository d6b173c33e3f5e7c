"""Token ids of texts by the tokenizers library, with a bounded cache of word chunks.

The tokenizers used here split a text into words and runs of signs before they look anything up, so a text's
ids are its chunks' ids in turn, as long as chunks end where such a split must be: before a space or line feed
that follows another character, and between a letter and an ASCII sign.  A chunk's ids come from the
tokenizers library once and are then looked up.  The cache is bounded; chunks beyond it are encoded each time.

A batch of texts is first cut at its spaces and line feeds by Arrow, and its distinct words are numbered, without the
stop or comma that ends them; what is not in the table of known words is cut into chunks, and the batch's ids are
gathered from its words'.
"""

from __future__ import annotations

import os
import re
from array import array

CACHE_CHUNKS = 300_000
LONGEST_CACHED = 32
TEXT_BYTES = 3_000_000  # of texts that are worked on at a time
START = "\x1e"  # stands for the start of a text, which no space precedes; texts that hold it are odd
ODD = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n "
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = rf"[{_LETTERS}]+(?=[ \n!-/:-@\[-`{{-~])"
_PLAIN = re.compile(rf" ?[{_LETTERS}]+").fullmatch


def _byte_signs() -> dict[int, str]:
    """What the byte-level alphabet writes for each non-ASCII Latin-1 letter (and for the space)."""
    stay = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in stay)}
    sign = lambda b: chr(b if b in stay else moved[b])
    return {c: "".join(map(sign, chr(c).encode())) for c in (0x20, *range(0xC0, 0x100))}


_SIGNS = _byte_signs()


class _Known(dict):
    """Chunk to ids; what is missing is encoded, and kept while there is room.

    A chunk of plain letters needs no normalising or splitting: the tokenizer's model takes it as it is.
    """

    def __init__(self, tokenizer, spaces_matter: bool, most: int):
        super().__init__()
        self.most = most
        self.encode, self.model, self.spaces_matter = tokenizer.encode, tokenizer.model.tokenize, spaces_matter

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN(chunk) and (self.spaces_matter or chunk.islower()):
            signs = chunk if chunk.isascii() and chunk[0] != " " else chunk.translate(_SIGNS)
            ids = array("I", [t.id for t in self.model(signs)]).tobytes()
        else:
            ids = array("I", self.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(self) < self.most and len(chunk) <= LONGEST_CACHED:
            self[chunk] = ids
        return ids


def _gathered(flat, starts, sizes):
    """The runs of ``flat`` that begin at ``starts``, one after another."""
    import numpy as np

    ends = np.cumsum(sizes, dtype=np.int64)
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    at += np.repeat(starts - (ends - sizes), sizes)
    return flat[at]


def _without_stops(words):
    """The words of a string array without the stop or comma that follows a letter at their end, and those signs (0: none)."""
    import numpy as np
    import pyarrow as pa

    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return words, np.zeros(len(words), np.uint8)
    sizes, at = np.diff(offsets), offsets[1:] - 1
    last, before, third = (data.take(at - i, mode="wrap") for i in range(3))
    letter = ((before | 32) - np.uint8(97) < 26) & (sizes > 1)
    # the Latin-1 letters in UTF-8
    letter |= (third == 0xC3) & (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7) & (sizes > 2)
    stop = letter & ((last == 46) | (last == 44))
    kept = np.ones(len(data), bool)
    kept[at[stop]] = False
    offsets[1:] -= np.cumsum(stop, dtype=np.int32)
    cores = pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(data[kept]))
    return cores, np.where(stop, last, np.uint8(0))


class ChunkEncoder:
    """Ids of texts; null counts as empty.

    ``spaces_matter``: white space becomes ids (byte-level).  Words then carry the space or line feeds before them; a
    text with other white space, or with a space next to white space, is encoded by itself.  Otherwise white space only
    separates words, and case is of no matter: ASCII letters are lowered first, unless the text may hold a special token.
    """

    def __init__(self, path: str, spaces_matter: bool, most: int = CACHE_CHUNKS, text_bytes: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if array("I").itemsize != 4:
            raise RuntimeError("ids need unsigned 32-bit arrays")
        self.known = _Known(tokenizer, spaces_matter, most // 3)
        # the words known, their ids one after another, and where each word's begin (and the last ends)
        self.words, self.flat, self.bounds = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.most, self.spaces_matter, self.text_bytes = most, spaces_matter, text_bytes or TEXT_BYTES
        self.chunks = re.compile(
            rf" ?{_WORD}|\n(?=[A-Za-z])|[ \n]*[^ \n]+|[ \n]+" if spaces_matter else rf"{_WORD}|[^ \n]+"
        ).findall
        self.odd = re.compile(r"[^\S \n]").search

    def _alone(self, text: str) -> bytes:
        """The ids of one text."""
        if self.spaces_matter:
            chunks = [text] if self.odd(text) else self.chunks(text)
        else:
            if "<|" not in text:
                text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            chunks = self.chunks(text)
        return b"".join(map(self.known.__getitem__, chunks))

    def _new(self, words: list[str]):
        """(ids, bounds) of words as ``arrays`` cuts them off."""
        import numpy as np

        ids, bounds, model, known = array("I"), [0], self.known.model, self.known.__getitem__
        for text in words:
            space = ""
            if self.spaces_matter:
                if text[:1] == START:
                    text = text[1:]
                elif text[:1] != "\n":
                    space = " "  # and no more for the space that ends a text
            # letters, which the tokenizer's model takes as they are
            if text.isalpha() and (self.spaces_matter or text.islower()) and (text.isascii() or _PLAIN(text)):
                signs = text if text.isascii() else text.translate(_SIGNS)
                ids.extend([t.id for t in model(_SIGNS[0x20] + signs if space else signs)])
            else:
                ids.frombytes(b"".join(map(known, self.chunks(space + text))))
            bounds.append(len(ids))
        return np.array(ids, "<u4"), np.array(bounds, np.int64)

    def _cores(self, words):
        """(ids, starts, sizes) of each word of a string array; words that are new are kept while there is room."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.index_in(words, value_set=self.words)
        missing = words.filter(found.is_null())
        flat, bounds = self._new(missing.to_pylist())
        which = found.fill_null(0).to_numpy().astype(np.int64)
        which[found.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(missing))
        every = np.concatenate([self.flat, flat])
        places = np.concatenate([self.bounds[:-1], bounds + self.bounds[-1]])
        starts, sizes = places[which], places[which + 1] - places[which]
        room = self.most - len(self.words)
        if room > 0 and len(missing):
            short = np.flatnonzero(pc.binary_length(missing).to_numpy() <= LONGEST_CACHED)[:room]
            some = np.diff(bounds)[short]
            self.words = pa.concat_arrays([self.words, missing.take(pa.array(short))])
            self.flat = np.concatenate([self.flat, _gathered(flat, bounds[short], some)])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(some)])
        return every, starts, sizes

    def _words(self, dictionary):
        """(ids, bounds) of each word of a string array."""
        import numpy as np

        n = len(dictionary)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        cores, stops = _without_stops(dictionary)
        numbered = cores.dictionary_encode()
        flat, starts, sizes = self._cores(numbered.dictionary)
        which = numbered.indices.to_numpy()
        # a word is the run of its core and that of its stop
        signs = [np.frombuffer(self.known[x], "<u4") for x in ".,"]
        at, size = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
        at[:, 0], size[:, 0] = starts[which], sizes[which]
        for sign, ids in zip(b".,", signs):
            ends = stops == sign
            at[ends, 1], size[ends, 1] = len(flat), len(ids)
            flat = np.concatenate([flat, ids])
        return _gathered(flat, at.reshape(-1), size.reshape(-1)), np.concatenate([[0], np.cumsum(size.sum(axis=1))])

    def arrays(self, texts):
        """(ids, bounds): text i of a string array has the ids ``ids[bounds[i]:bounds[i + 1]]``."""
        import numpy as np
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        ids, bounds, at = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)], 0
        while at < len(texts):  # some at a time: what is worked on is several times as large
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + self.text_bytes, side="right")))
            got, cuts = self._arrays(texts.slice(at, to - at))
            ids.append(got)
            bounds.append(cuts[1:] + bounds[-1][-1])
            at = to
        return np.concatenate(ids), np.concatenate(bounds)

    def _arrays(self, texts):
        import numpy as np
        import pyarrow.compute as pc

        alone = np.zeros(0, np.int64)
        if self.spaces_matter:
            odd = pc.match_substring_regex(texts, ODD)
            alone = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            cut = pc.binary_join_element_wise(START, pc.replace_substring_regex(texts, "\n+", " \\0"), "")
            cut = pc.if_else(odd, START, cut)
        else:
            lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
            cut = pc.replace_substring(lowered, "\n", " ")
        lists = pc.split_pattern(cut, " ")
        numbered = lists.flatten().dictionary_encode()
        flat, places = self._words(numbered.dictionary)
        starts, sizes = places[:-1], np.diff(places)
        if self.spaces_matter and len(alone):
            # an odd text is a word of its own
            place = len(sizes) + np.arange(len(alone))
            more = [np.frombuffer(self._alone(texts[int(i)].as_py()), "<u4") for i in alone]
            sizes = np.concatenate([sizes, [len(x) for x in more]])
            starts, flat = np.cumsum(sizes) - sizes, np.concatenate([flat, *more])
        which = numbered.indices.to_numpy(zero_copy_only=False)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        if self.spaces_matter and len(alone):
            which = which.copy()
            which[bounds[alone]] = place  # an odd text was cut to one word, of nothing
        n = sizes[which]
        return _gathered(flat, starts[which], n), np.concatenate([[0], np.cumsum(n)])[bounds]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        import pyarrow as pa

        got, bounds = self.arrays(pa.array(texts, pa.string()))
        return [got[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, spaces_matter: bool, most: int = CACHE_CHUNKS, text_bytes: int | None = None) -> ChunkEncoder:
    """One encoder for each Python worker, tokenizer file and sizes, with up to ``most`` words kept (some 40 bytes each)."""
    key = (path, spaces_matter, most, text_bytes)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, spaces_matter, most, text_bytes)
    return _ENCODERS[key]
