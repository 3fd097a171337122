"""Ids of whole texts exactly as a public tokenizer file gives them, with the words of a task encoded once.

A text is cut where the tokenizer itself always cuts, so the ids of the pieces, one after
the other, are the ids of the text:

* ``byte`` (byte-level BPE whose words carry their leading space): before a space that a
  non-blank follows.
* ``word`` (BPE with word ends that drops blanks and ignores case): at every space.

Pieces that are letters and then ASCII punctuation are cut between the two as well, because
no pre-token of either file goes from a letter to punctuation.  New letter runs are encoded
together in one call.  Anything else goes to the library as it is, and so does a whole text
that holds the string of a special token.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿœŒ"
#: letters, ASCII punctuation but the apostrophe, and the same again on a next line
PLAIN = re.compile(rf"([{LETTERS}]+)([!-&(-/:-@\[-`{{-~]*)(?:\n([{LETTERS}]+)([!-&(-/:-@\[-`{{-~]*))?")
_MARK = r"[!-&(-/:-@\[-`{-~]*"
PARTS = rf"\A(?P<a>[{LETTERS}]+)(?P<m>{_MARK})(?:\n(?P<b>[{LETTERS}]+)(?P<n>{_MARK}))?\z"
CACHED_PIECES = 1_000_000  # entries of a cache; a full one starts anew
LONGEST_CACHED = 48  # characters of a piece that is kept
RUNS_PER_CALL = 256
BLOCK_CHARACTERS = 500_000


def load(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def version(file: str) -> str:
    """Digest that names a tokenizer: its file and the library's version."""
    import tokenizers

    with open(file, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Ragged:
    """Arrays of ids of any lengths, one after the other."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.values, self.lengths = values, lengths
        self.starts = np.cumsum(lengths) - lengths

    @staticmethod
    def of(parts: Sequence[bytes]) -> Ragged:
        return Ragged(np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4)

    def take(self, index: np.ndarray) -> Ragged:
        lengths = self.lengths[index]
        places = np.repeat(self.starts[index] - (np.cumsum(lengths) - lengths), lengths)
        places += np.arange(len(places))
        return Ragged(self.values[places], lengths)

    def join(self, numbers: np.ndarray) -> Ragged:
        """Neighbours joined, ``numbers`` of them each."""
        at = np.concatenate([[0], np.cumsum(self.lengths)])
        ends = np.cumsum(numbers)
        return Ragged(self.values, at[ends] - at[ends - numbers])

    def parts(self) -> list[bytes]:
        raw = self.values.astype("<u4", copy=False).tobytes()
        return [raw[4 * a : 4 * (a + n)] for a, n in zip(self.starts.tolist(), self.lengths.tolist())]


class Encoder:
    """Turns texts into bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, file: str, style: str, cached: int = CACHED_PIECES) -> None:
        self.cached = cached
        if style not in ("byte", "word"):
            raise ValueError(f"style is byte or word, not {style}")
        self.tokenizer, self.word_style = load(file), style == "word"
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        mark = (lambda t: t.endswith("</w>")) if self.word_style else (lambda t: t.startswith("Ġ"))
        for token, i in vocabulary.items():
            self.edge[i] = mark(token)
        self.newline = b"" if self.word_style else self.whole("\n")
        self.pieces: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.lone: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _runs(self, runs: Sequence[str]) -> None:
        """Encode letter runs, each after a space, and keep their ids."""
        for i in range(0, len(runs), RUNS_PER_CALL):
            part = runs[i : i + RUNS_PER_CALL]
            # The fast call keeps no offsets; the ids are the same.
            found = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
            ids = np.array(found[0].ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            cuts = (edges + 1 if self.word_style else edges).tolist()
            cuts = [0, *cuts] if self.word_style else [*cuts, len(ids)]
            if len(cuts) == len(part) + 1 and cuts[0] == 0 and cuts[-1] == len(ids):
                raw = ids.tobytes()
                self.cores.update((r, raw[4 * a : 4 * b]) for r, a, b in zip(part, cuts, cuts[1:]))
            else:
                self.cores.update((r, self.whole(" " + r)) for r in part)

    def _bare(self, piece: str) -> bytes:
        """Ids of a piece that no space precedes."""
        ids = self.lone.get(piece)
        if ids is None:
            ids = self.whole(piece)
            if len(piece) <= LONGEST_CACHED:
                self.lone[piece] = ids
        return ids

    def _learn(self, new: set[str]) -> None:
        """Fill the cache of pieces that follow a space."""
        cores, pieces, bare = self.cores, self.pieces, self._bare
        plain, runs = [], set()
        for piece in new:
            m = PLAIN.fullmatch(piece)
            if m is None:
                pieces[piece] = self.whole(piece if self.word_style else " " + piece)
                continue
            first, mark, second, last = parts = m.groups()
            plain.append((piece, parts))
            if first not in cores:
                runs.add(first)
            if second and self.word_style and second not in cores:
                runs.add(second)
        self._runs(list(runs))
        for piece, (first, mark, second, last) in plain:
            ids = cores[first]
            if mark:
                ids += bare(mark)
            if second:
                ids += cores[second] if self.word_style else self.newline + bare(second)
                if last:
                    ids += bare(last)
            pieces[piece] = ids

    def _cut(self, text: str) -> list[str]:
        pieces = text.split(" ")
        if self.word_style:
            return pieces
        kept = [pieces[0]]
        for p in pieces[1:]:
            if p and not p[0].isspace():
                kept.append(p)
            else:
                kept[-1] += " " + p
        return kept

    def many(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text; null is an empty text."""
        out: list[bytes] = []
        size, start = 0, 0
        for i, text in enumerate(texts):  # some at a time, so that pieces of few texts are held
            size += len(text or "")
            if size > BLOCK_CHARACTERS or i + 1 == len(texts):
                some = texts[start : i + 1]
                out += self._words(some) if self.word_style else self._some(some)
                size, start = 0, i + 1
        return out

    def _words(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of some MB of text in the ``word`` style, each different piece looked up once.

        A piece is up to two letter runs and two marks; ids of pieces, and then of texts, are
        gathered by codes.
        """
        column = pc.fill_null(pa.array(texts, pa.large_string()), "")
        special = np.zeros(len(column), bool)
        for s in self.specials:
            special |= np.asarray(pc.match_substring(column, s))
        # ASCII only; the tokenizer does the rest.
        pieces = pc.split_pattern(pc.ascii_lower(pc.if_else(pa.array(special), "", column)), " ")
        coded = pieces.flatten().dictionary_encode()
        table = self._pieces(coded.dictionary)
        found = table.take(np.asarray(coded.indices)).join(np.asarray(pc.list_value_length(pieces), np.int64)).parts()
        for i in np.flatnonzero(special):
            found[i] = self.whole(texts[i])
        return found

    def _pieces(self, pieces: pa.Array) -> Ragged:
        """Ids of different pieces without spaces."""
        if len(self.pieces) + len(self.cores) + len(self.lone) > self.cached:
            self.pieces, self.cores, self.lone = {}, {}, {}
        split = pc.extract_regex(pieces, PARTS)
        short = np.asarray(pc.less_equal(pc.utf8_length(pieces), LONGEST_CACHED))
        plain = np.asarray(split.is_valid()) & short
        parts = split.filter(pa.array(plain)).flatten()
        runs = pa.concat_arrays([parts[0], parts[2]]).dictionary_encode()
        marks = pa.concat_arrays([parts[1], parts[3]]).dictionary_encode()
        run_texts = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        mark_texts = marks.dictionary.to_pylist()
        self.cores.setdefault("", b"")
        self._runs([r for r in run_texts if r not in self.cores])
        other = np.flatnonzero(~plain)
        other_ids = []
        for text, is_short in zip(pieces.take(pa.array(other)).to_pylist(), short[other].tolist()):
            ids = self.pieces.get(text)
            if ids is None:
                ids = self.whole(text) if text else b""
                if is_short:
                    self.pieces[text] = ids
            other_ids.append(ids)
        table = Ragged.of(
            [*map(self.cores.__getitem__, run_texts), *(self._bare(m) if m else b"" for m in mark_texts), *other_ids, b""]
        )
        n, first_mark, first_other = int(plain.sum()), len(run_texts), len(run_texts) + len(mark_texts)
        codes = np.full((len(pieces), 4), first_other + len(other), np.int64)
        run_codes, mark_codes = np.asarray(runs.indices), np.asarray(marks.indices) + first_mark
        codes[plain] = np.stack([run_codes[:n], mark_codes[:n], run_codes[n:], mark_codes[n:]], 1)
        codes[other, 0] = first_other + np.arange(len(other))
        return table.take(codes.ravel()).join(np.full(len(pieces), 4, np.int64))

    def _some(self, texts: Sequence[str | None]) -> list[bytes]:
        cut: list[list[str] | None] = []
        for text in texts:
            if text and not any(s in text for s in self.specials):
                if self.word_style:
                    text = text.encode().lower().decode()  # ASCII only; the tokenizer does the rest
                cut.append(self._cut(text))
            else:
                cut.append(None)
        get = self.pieces.get
        bodies = [c if c is None or self.word_style else c[1:] for c in cut]
        found = [None if b is None else list(map(get, b)) for b in bodies]
        short = [i for i, x in enumerate(found) if x and None in x]
        if short:
            new = {p for i in short for p, x in zip(bodies[i], found[i]) if x is None}
            long = {p for p in new if len(p) > LONGEST_CACHED}
            if len(self.pieces) + len(self.cores) + len(self.lone) > self.cached:
                self.pieces, self.cores, self.lone = {}, {}, {}
            self._learn(new - long - {""})
            aside = {p: self.whole(p if self.word_style else " " + p) for p in long}
            aside[""] = b""
            get = self.pieces.get
            for i in short:
                found[i] = [x if x is not None else aside[p] if p in aside else get(p) for p, x in zip(bodies[i], found[i])]
        out = []
        for text, c, ids in zip(texts, cut, found):
            if ids is None:
                out.append(self.whole(text) if text else b"")
            else:
                head = b"" if self.word_style or not c[0] else self._bare(c[0])
                out.append(head + b"".join(ids))
        return out
