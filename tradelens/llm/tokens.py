"""Token ids of whole texts: those that one plain call of the tokenizer gives for the text.

Texts are cut into words by Arrow, each distinct word of a batch is looked up once, and words that a
worker has not met are encoded together. The ids are then gathered from one array by NumPy, so no
Python code runs per word of a text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

from tradelens.llm.common import tokenizer_file

#: A worker that knows more words than this forgets those that it has met in one batch only.
CACHE_WORDS = 800_000
PUNCTUATION = ".,;:!?#$%&*+-/=@^_~()[]{}|"
#: New words are encoded together, so many at once.
TOGETHER = 32
#: Bytes of text in a batch, and characters in a piece of a text that is encoded whole.
BATCH_BYTES, PIECE = 8_000_000, 1 << 16
#: A space or line end inside a run of white space: its place there decides its token.
INSIDE_RUN = r"[\s\pZ\x0b\x1c-\x1f\x{85}][ \n](?:[\s\pZ\x0b\x1c-\x1f\x{85}]|\z)"
#: Ends with a letter or digit, in lower case as well (dotted I becomes a letter and a mark).
LETTER_LAST = r"(?:[^\PL\x{130}]|\pN)\z"
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Encodes texts word by word and remembers the ids of each word.

    ``byte``: byte-level vocabulary. White space after a word starts a new token, and so does the last
    character of a run of white space, so a text may be cut there; a space goes with the word after it.
    ``word``: vocabulary that drops white space, so a text may be cut at any of it.
    Texts with other runs of white space, or with a special token's string, are encoded whole (long
    ones in pieces, cut at single spaces between words).
    """

    def __init__(self, name: str, kind: str):
        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        self.kind = kind
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: Stands between words that are encoded together: text on its two sides never shares a token.
        self.glue = next(iter(self.special))
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.often = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool)
        self._empty()

    def _empty(self) -> None:
        self.words: dict[str, int] = {}  # words after white space
        self.firsts: dict[str, int] = {}  # words that nothing stands before
        self.n = self.used = 0
        self._add((), (0,))  # number 0: no ids

    def _add(self, ids, sizes) -> int:
        """Append entries, whose ids stand one after another; the number of the first."""
        import numpy as np

        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.n + len(sizes) > len(self.start):
            self.start, self.size, self.often = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size, self.often))
        first, stop, sizes = self.n, self.n + len(sizes), np.asarray(sizes, np.int64)
        self.pool[self.used : self.used + len(ids)] = ids
        self.size[first:stop] = sizes
        self.start[first:stop] = self.used + np.cumsum(sizes) - sizes
        self.often[first:stop] = False
        self.used, self.n = self.used + len(ids), stop
        return first

    def _ids_of(self, index: int):
        return self.pool[self.start[index] : self.start[index] + self.size[index]]

    def _encode(self, units: list[str]) -> int:
        """Encode units that have no special token in them; the number of the first."""
        import numpy as np

        first, glue = self.n, self.special[self.glue]
        for lo in range(0, len(units), TOGETHER * 512):
            some = units[lo : lo + TOGETHER * 512]
            joined = [self.glue.join(some[i : i + TOGETHER]) + self.glue for i in range(0, len(some), TOGETHER)]
            got = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.concatenate([np.array(g.ids, np.uint32) for g in got])
            ends = np.flatnonzero(ids == glue)
            self._add(ids[ids != glue], np.diff(np.concatenate(([-1], ends))) - 1)
        return first

    def _known(self, words, table: dict[str, int], space: str):
        """The numbers of distinct words; ``space`` is what stands before one that does not begin with a line end."""
        import numpy as np

        at = np.fromiter(map(table.get, words, repeat(-1)), np.int64, len(words))
        self.often[at[at >= 0]] = True
        unmet = np.flatnonzero(at < 0)
        new = [words[k] for k in unmet.tolist()]
        if new:
            first = self._encode([space + w if w[:1] != "\n" else w for w in new] if space else new)
            at[unmet] = np.arange(first, first + len(new))
            table.update(zip(new, at[unmet].tolist()))
        return at

    def _index(self, words, table: dict[str, int], space: str):
        """For each word of an Arrow array the number of what stands before its last punctuation, and that of the punctuation.

        Punctuation after a letter or digit is a token of its own, so the word before it is looked up;
        a word that has none is looked up as it is, with no ids for the second part.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        stems = pc.utf8_rtrim(words, PUNCTUATION)
        cut = pc.and_(pc.not_equal(pc.binary_length(stems), pc.binary_length(words)), pc.match_substring_regex(stems, LETTER_LAST))
        whole = pc.if_else(cut, stems, words).dictionary_encode()
        number = self._known(whole.dictionary.to_numpy(zero_copy_only=False).tolist(), table, space)[whole.indices.to_numpy(zero_copy_only=False)]
        second = np.zeros(len(number), np.int64)
        places = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        lengths = pc.utf8_length(stems.take(pa.array(places))).to_numpy(zero_copy_only=False).tolist()
        tails = pa.array([w[n:] for w, n in zip(words.take(pa.array(places)).to_numpy(zero_copy_only=False), lengths)], pa.large_string()).dictionary_encode()
        second[places] = self._known(tails.dictionary.to_pylist(), self.firsts, "")[tails.indices.to_numpy(zero_copy_only=False)]
        return np.stack((number, second), axis=1)

    def _joined(self, both):
        """The numbers of the joined parts, as new entries where there are two."""
        import numpy as np

        number, places = both[:, 0].copy(), np.flatnonzero(both[:, 1])
        some = both[places]
        number[places] = self._add(self._gather(some.ravel()), self.size[some].sum(axis=1)) + np.arange(len(places))
        return number

    def _gather(self, number):
        """The ids of entries, one after another."""
        import numpy as np

        size = self.size[number]
        stop = np.cumsum(size)
        return self.pool[np.repeat(self.start[number] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]

    def _forget(self) -> None:
        """Keep the words met in more than one batch; none, if they alone are too many."""
        import numpy as np

        kept = [(table, [(w, i) for w, i in table.items() if self.often[i]]) for table in (self.words, self.firsts)]
        if sum(len(x) for _, x in kept) > CACHE_WORDS // 2:
            kept = [(table, []) for table, _ in kept]
        bodies = [(table, x, [self._ids_of(i).copy() for _, i in x]) for table, x in kept]
        self._empty()
        for table, x, ids in bodies:
            if x:
                first = self._add(np.concatenate(ids), np.array([len(b) for b in ids]))
                own = self.words if table is bodies[0][0] else self.firsts
                own.update((w, first + k) for k, (w, _) in enumerate(x))

    def _whole(self, text: str):
        """The ids of one text without the help of the table."""
        import numpy as np

        pieces, at = [], 0
        while len(text) - at > PIECE:
            cut = BETWEEN_WORDS.search(text, at + PIECE)
            if not cut:
                break
            pieces.append(text[at : cut.start()])
            at = cut.start()
        pieces.append(text[at:])
        return np.concatenate([np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32) for p in pieces])

    def encode(self, texts, end_id: int | None = None):
        """All ids of an Arrow array of texts, and for each text the place after its last id. Nulls are empty.

        ``end_id``, if given, ends every text.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.n > CACHE_WORDS:
            self._forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring(texts, self.glue)
        for token in list(self.special)[1:]:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        if self.kind == "byte":
            odd = pc.or_(odd, pc.match_substring_regex(texts, INSIDE_RUN))
        places = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(odd, "", texts) if len(places) else texts
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", " \n" if self.kind == "byte" else " "), " ")
        ends = np.diff(cut.offsets.to_numpy(zero_copy_only=False)).cumsum()  # after the last word of each text
        begins = np.concatenate(([0], ends[:-1]))
        coded = cut.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if self.kind == "byte":
            inner = np.ones(len(code), bool)
            inner[begins] = False
            after = np.zeros(len(words), bool)
            after[code[inner]] = True
            after = np.flatnonzero(after)
            lead, where = np.unique(code[begins], return_inverse=True)
            of_after = self._index(words.take(pa.array(after)), self.words, " ")
            of_lead = self._index(words.take(pa.array(lead)), self.firsts, "")
            n, used = self.n, self.used
            at = np.zeros(len(words), np.int64)
            at[after] = self._joined(of_after)
            number = at[code]
            number[begins] = self._joined(of_lead)[where]
        else:
            of_word = self._index(words, self.firsts, "")
            n, used = self.n, self.used
            number = self._joined(of_word)[code]
        for k in places.tolist():
            ids = self._whole(texts[k].as_py())
            number[begins[k]] = self._add(ids, np.array([len(ids)]))
        if end_id is not None:
            number = np.insert(number, ends, self._add(np.array([end_id], np.uint32), np.array([1])))
            ends = ends + np.arange(1, len(ends) + 1)
        size = self.size[number]
        stop = np.cumsum(size)
        ids = self._gather(number)
        self.n, self.used = n, used  # joined words, whole texts and the end belong to this batch alone
        return ids, np.concatenate(([0], stop))[ends]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, kind: str) -> Encoder:
    """One encoder per worker process: what it has learned serves the worker's next tasks."""
    if (name, kind) not in _ENCODERS:
        _ENCODERS[name, kind] = Encoder(name, kind)
    return _ENCODERS[name, kind]


def batches(texts, most_bytes: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of an Arrow array whose texts hold about so many bytes."""
    import numpy as np
    import pyarrow.compute as pc

    total = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(total):
        before = total[start - 1] if start else 0
        stop = int(np.searchsorted(total, before + most_bytes, side="left")) + 1
        yield start, min(stop, len(total))
        start = stop
