"""Token counts under a unigram vocabulary, without building the tokens: Viterbi that carries scores and counts only.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a word; dynamic programming over the ends of pieces
carries the best score and the number of pieces. Tie rules are those of the tokenizers library's Unigram model:
candidates for an end come in the order of their starts, a later one wins only with a strictly larger score, and a
character that no one-character piece covers may be an unknown piece with the smallest score less 10; neighbouring
unknown pieces count as one, or with byte fallback as one token for each of their UTF-8 bytes.

Words are what the Metaspace step makes: every blank becomes ``▁`` and begins a word, and a word begins a non-empty
text. Words are cached in each worker, in a bounded cache. Scores come with the vocabulary: those of the public sentencepiece
file are the ranks of its merges, not log probabilities, so its counts are those of a unigram model with these scores.
Defined cases: null and empty texts have 0 tokens; repeated rows get equal counts; a word of any length is handled whole,
in memory that doesn't grow with it; an empty table gives no rows; a kept column named as a result gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Cache, public_path
from .common import map_texts

MARK = "▁"
WORDS = 300_000
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class Counter:
    """Counts tokens; lives in a worker, with its cache."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int | None = 0, byte_fallback: bool = True):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for i, (p, s) in enumerate(pieces):
            if p:
                self.auto.add_word(p, (len(p), s, i == unknown))
        self.auto.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.least = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.auto for b in range(256))
        self.known = Cache(WORDS)

    def word(self, text: str) -> int:
        """Tokens of one word: the best path's pieces.

        Of each end of a piece it keeps the best score, the count, and how the path ends there: 0 with a piece, else the length
        of its unknown tail. Ends farther back than the longest piece are overwritten, so memory doesn't grow with the word.
        The automaton names the pieces of one end from the longest to the shortest, that is in the order of their starts.
        """
        size = self.longest + 1
        score, count, tail = [0.0] * size, [0] * size, [0] * size
        found = self.auto.iter(text)
        last, got = next(found, (-1, None))
        for end in range(1, len(text) + 1):
            best, n, unknown, single = -1e300, 0, 0, False
            while got is not None and last == end - 1:
                length, s, unk = got
                at = (end - length) % size
                single |= length == 1
                if score[at] + s > best:
                    best, n, unknown = score[at] + s, count[at] + 1, 0
                    if unk:
                        n, unknown = self._unknown(text[end - length : end], count[at], tail[at])
                last, got = next(found, (-1, None))
            at = (end - 1) % size
            if not single and score[at] + self.least > best:
                best = score[at] + self.least
                n, unknown = self._unknown(text[end - 1], count[at], tail[at])
            at = end % size
            score[at], count[at], tail[at] = best, n, unknown
        return count[len(text) % size]

    def _unknown(self, part: str, count: int, tail: int) -> tuple[int, int]:
        """Count and length of the unknown tail behind one more unknown part."""
        return count + (len(part.encode()) if self.bytes else not tail), tail + len(part)

    def count(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        young, old = self.known.young, self.known.old
        for i, w in enumerate(words):
            got = young.get(w)
            if got is None:
                got = old.get(w)
                if got is None:
                    got = self.word(w)
                self.known.put(w, got)
                young, old = self.known.young, self.known.old
            out[i] = got
        return out


def words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, their number for each word of all texts, and the texts' n + 1 offsets."""
    col = texts.fill_null("")
    marked = pc.replace_substring(col, " ", MARK)
    # a mark in front, but for a text that is empty or begins with one
    starts = pc.or_(pc.starts_with(marked, MARK), pc.equal(marked, ""))
    marked = pc.if_else(starts, marked, pc.binary_join_element_wise(MARK, marked, ""))
    parts = pc.split_pattern(marked, MARK)  # the first part of each text is empty
    off = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten().dictionary_encode()
    ids = flat.indices.to_numpy(zero_copy_only=False)
    off = off - off[0]
    keep = np.ones(len(ids), bool)
    keep[off[:-1][np.diff(off) > 0]] = False
    return [MARK + w for w in flat.dictionary.to_pylist()], ids[keep], np.r_[0, np.cumsum(keep)][off]


def counted(docs: DataFrame, pieces_path: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), byte_fallback: bool = True) -> DataFrame:
    """`keep`, n_tokens and n_words (both long) of each whole text. pieces_path: a sentencepiece file that workers can read."""

    def make():
        counter = Counter(vocabulary(pieces_path or public_path("piece_bpe_32k.model")), 0, byte_fallback)

        def run(texts: pa.Array) -> list[pa.Array]:
            vocab, ids, off = words(texts)
            per = counter.count(vocab)[ids] if len(ids) else np.zeros(0, np.int64)
            total = np.r_[0, np.cumsum(per)][off]
            return [pa.array(np.diff(total)), pa.array(np.diff(off))]

        return run

    return map_texts(docs, text_col, list(keep), [T.StructField("n_tokens", T.LongType()), T.StructField("n_words", T.LongType())], make)


def op8(docs: DataFrame) -> DataFrame:
    return counted(docs)
