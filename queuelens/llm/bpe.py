"""Byte-pair encoding of whole texts with the tokenizers library, with a memory of encoded words per task process.

The tokenizer never joins characters across the place where white space begins, never a run of letters with the
punctuation after it, and never a single line end with what stands around it. A text whose words are parted by single
spaces and line ends is therefore the ids of its words in a row, each with the space before it if there is one. The
distinct words of a batch of texts are looked up or encoded once, and the texts' ids are gathered from them. A look-up
costs the same however many words are known, and words that are not known are encoded many at a time, a line each. Any other
text (further white space or control characters, two separators in a row, separators at its ends, a string that is an added
token of the vocabulary) is encoded whole.
"""

from __future__ import annotations

import array
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_of

#: Texts to encode whole. White space and control characters are listed, as the pattern engine knows ASCII ones only.
WHOLE = (r"[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}"
         r"\x{feff}]|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z")
#: A letter (Latin) with punctuation after it; the apostrophe is left out (contractions).
TAIL = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-&(-/:-@\[-`{-~])"
#: Marks a word that has no space before it.
BARE = "\x01"
#: Words that are encoded in one text.
TOGETHER = 100
_OPEN: dict[str, Encoder] = {}


class Encoder:
    """``words`` has the known words' ids as bytes (some 150 bytes a word)."""

    def __init__(self, path: str, most_cached: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the library finds these strings in a text before anything else
        self.whole = "|".join([WHOLE, *(re.sub(r"[^A-Za-z0-9]", lambda m: rf"\x{{{ord(m[0]):x}}}", t) for t in added)])
        self.most_cached = most_cached
        line_end, = self.plain(["\n"])
        self.line_end = np.frombuffer(line_end, "<u4")[0]  # one byte, so one id, and no other word has it
        self.words = {BARE + "\n": line_end}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, straight from the library."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", f.ids).tobytes() for f in found]

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of each word; no word is a line end."""
        texts = [w[1:] if w[0] == BARE else " " + w for w in words]
        lines = b"".join(self.plain(["\n".join(texts[k:k + TOGETHER]) + "\n" for k in range(0, len(texts), TOGETHER)]))
        ends = (4 * np.flatnonzero(np.frombuffer(lines, "<u4") == self.line_end)).tolist()
        return [lines[a:b] for a, b in zip([0, *(x + 4 for x in ends)], ends)]

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct ``words`` in a row, and how many each has."""
        ids = list(map(self.words.get, words))
        new = [k for k, x in enumerate(ids) if x is None]
        added = [words[k] for k in new]
        found = self._encoded(added)
        for k, x in zip(new, found):
            ids[k] = x
        room = max(self.most_cached - len(self.words), 0)
        self.words.update(zip(added[:room], found))
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) >> 2

    def _gathered(self, texts: pa.Array) -> list[bytes]:
        lines = pc.replace_substring(texts, "\n", f" {BARE}\n {BARE}")
        parted = pc.replace_substring_regex(lines, TAIL, rf"\1 {BARE}\2")
        lists = pc.split_pattern(pc.binary_join_element_wise(BARE, parted, ""), " ")
        known = lists.flatten().dictionary_encode()
        ids, sizes = self._ids_of(known.dictionary.to_numpy(zero_copy_only=False).tolist())
        starts = np.cumsum(sizes) - sizes
        at = known.indices.to_numpy()
        counts = sizes[at]
        ends = np.cumsum(counts, dtype=np.int64)
        line = ids[np.repeat(starts[at] - (ends - counts), counts) + np.arange(len(at) and ends[-1])]
        edges = np.concatenate(([0], ends))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [line[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """As ``plain`` (null: empty text), with the memory."""
        column = pa.array([text_of(t) for t in texts], pa.string())
        odd = pc.match_substring_regex(column, self.whole).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for rows, encode in ((np.flatnonzero(~odd), self._gathered),
                             (np.flatnonzero(odd), lambda x: self.plain(x.to_pylist()))):
            if len(rows):
                for row, ids in zip(rows.tolist(), encode(column.take(pa.array(rows)))):
                    out[row] = ids
        pa.default_memory_pool().release_unused()
        return out
