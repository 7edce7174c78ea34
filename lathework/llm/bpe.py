"""BPE encoding and decoding by a prefix-sharing trie.

A word's encoding is known once the last token of each of its prefixes is: the last token of a prefix is the one vocabulary
entry that ends it and may stand after the last token of what precedes. So the distinct words of a slice of texts are put
in a trie, which is walked depth first with a stack of last-token states; words with a common prefix share its states, and
each is computed once. The trie is held as its words in order, each with the length it shares with the one before: that is
its depth-first walk, and takes no node objects.

Two tokens may stand together if no merge across their border comes before the merges that build them: the tokens on the
right edge of the left one and on the left edge of the right one are compared by merge rank (equal ranks go left to right).

The vocabulary is read on the driver from a tokenizer file (a parameter) and shared with the executors; its size is that of
the file. It must be a word BPE: byte-level letters, an end-of-word mark, no decoder. Texts are normalised and split into
words here for the scripts in PLAIN, and by the library's own normaliser and splitter where a text has other letters.

Edge cases: null and empty texts give no ids and an empty decoding; words of any length take linear time and memory;
special tokens' strings in a text are their ids, as the library does; rows are independent, so repeated rows, null ids and
extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import Shared, text_runs

#: Word pieces as the vocabulary's splitter takes them; fixed by the tokenizer file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters for which lower() and PIECES do what the library does, and that NFC leaves alone when there are no others.
PLAIN = r"[\x00-\x1B\x20-˿Ѐ-҂Ҋ-ԯ‐-‧一-鿿가-힣]*"
#: A worker keeps the encodings of the words it met last: this many, and as many from before.
KEPT_WORDS = 250_000
SLICE_BYTES = 1 << 20
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and the edges of tokens, from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = f.read()
        data = json.loads(whole)
        model = data["model"]
        if model["type"] != "BPE" or data["decoder"] or not model["end_of_word_suffix"] or PIECES not in whole.encode().decode("unicode_escape", "ignore"):
            raise ValueError(f"{path} is not a word BPE of the kind this operator encodes")
        self.file = whole
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.rank = {(a, b): r for r, (a, b) in enumerate(model["merges"])}
        self.made = {a + b: (a, b, r) for (a, b), r in reversed(self.rank.items())}
        self.edges: tuple[dict, dict] = ({}, {})
        letters = byte_letters()
        self.letters = letters
        self.tokens = {v: k for k, v in (self.ids | self.special).items()}
        plain = [t for t in self.made if not t.endswith(self.end)]
        self.inner = {t for t in plain if self._whole(t)} | set(letters)
        self.final = {t.removesuffix(self.end) for t in self.made if t.endswith(self.end) and self._whole(t)} | set(letters)
        self.longest_inner, self.longest_final = (max(map(len, x)) for x in (self.inner, self.final))
        self.fit: dict[tuple[str, str], bool] = {}

    def _whole(self, token: str) -> bool:
        """Whether the merges build the token from its letters, so that it can occur."""
        a, b, _ = self.made[token]
        return (a not in self.made or self._whole(a)) and (b not in self.made or self._whole(b)) and self.together(a, b, self.made[token][2])

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts along a token's left (0) or right (1) edge, each with the rank of the merge that takes it up."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            *parts, until = self.made[token]
            token = parts[side]

    def _edges(self, token: str, side: int) -> list[tuple[str, int]]:
        known = self.edges[side].get(token)
        if known is None:
            known = self.edges[side][token] = self._edge(token, side)
        return known

    def together(self, left: str, right: str, below: int = NEVER) -> bool:
        """Whether no merge joins a part of `left` with a part of `right` before they are whole; merges from `below` on don't count."""
        get = self.rank.get
        for x, x_until in self._edges(left, 1):
            for y, y_until in self._edges(right, 0):
                r = get((x, y), NEVER)
                if r < below and r < x_until and r <= y_until:
                    return False
        return True

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.fit.get(key)
        if known is None:
            known = self.fit[key] = self.together(left, right)
        return known

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of words in byte letters: the depth-first walk of their trie."""
        if len(self.fit) > 400_000:
            self.fit.clear()
        out: dict[str, tuple[int, ...]] = {}
        last: list[str] = []  # of each proper prefix, its last token
        before = ""
        inner, final, fits, known, ids, end, longest = self.inner, self.final, self.fits, self.fit.get, self.ids, self.end, self.longest_inner
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word) - 1, len(last))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared:]
            n = len(word)
            for i in range(shared + 1, n):
                for k in range(max(0, i - longest), i):
                    token = word[k:i]
                    if token in inner:
                        if k:
                            good = known((last[k - 1], token))
                            if not (fits(last[k - 1], token) if good is None else good):
                                continue
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token ends {word[:i]!r}")
            for k in range(max(0, n - self.longest_final), n):
                token = word[k:]
                if token in final:
                    if not k:
                        break
                    good = known((last[k - 1], token + end))
                    if fits(last[k - 1], token + end) if good is None else good:
                        break
            else:
                raise ValueError(f"no token ends {word!r}")
            parts = [ids[token + end]]
            while k:
                parts.append(ids[last[k - 1]])
                k -= len(last[k - 1])
            out[word] = tuple(reversed(parts))
            before = word
        return out

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


class Encoder:
    """A worker's encoder: splits texts at white space and keeps the ids of the chunks met last.

    No piece of the splitter holds white space, so a chunk's ids are those of its pieces; only unknown chunks are split further.
    """

    def __init__(self, vocabulary: Vocabulary):
        import re

        import regex
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary
        self.find = regex.compile(PIECES).findall
        self.plain = re.compile(PLAIN).fullmatch
        self.special = {"\0" + k: (v,) for k, v in vocabulary.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")").split
        self.library = Tokenizer.from_str(vocabulary.file)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text; a special token has a null before it, a word in byte letters two."""
        if any(k in text for k in self.vocabulary.special):
            parts = self.cut(text)
        elif "\0" not in text and self.plain(text):
            return text.lower().split()
        else:
            parts = [text]
        out = []
        for part in parts:
            if part in self.vocabulary.special:
                out.append("\0" + part)
            elif self.plain(part) and "\0" not in part:
                out += part.lower().split()
            else:
                out += ["\0\0" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def _pieces(self, chunk: str) -> tuple[str, ...] | list[str]:
        """The words of a chunk; letters alone, or with one other sign behind, need no splitter."""
        if chunk.isalpha() or chunk.startswith("\0\0"):
            return (chunk,)
        if not chunk[-1].isalnum() and chunk[:-1].isalpha():
            return (chunk[:-1], chunk[-1])
        return self.find(chunk)

    def _learn(self, chunks: set[str]) -> None:
        """Ids of chunks not met lately, through the trie of their distinct words."""
        letters = self.vocabulary.letters
        split = {c: self._pieces(c) for c in chunks if c not in self.special}
        words = set(chain.from_iterable(split.values()))
        coded = {w: self.young.get(w) or self.old[w] for w in words if w in self.young or w in self.old}
        # A printable ASCII word is its own byte letters.
        new = {w: w if w.isascii() and w.isprintable() else w[2:] if w.startswith("\0\0") else "".join(map(letters.__getitem__, w.encode())) for w in words.difference(coded)}
        fresh = self.vocabulary.encode_words(list(set(new.values())))
        coded.update((w, fresh[x]) for w, x in new.items())
        self.young.update((c, tuple(chain.from_iterable(map(coded.__getitem__, words)))) for c, words in split.items())
        self.young.update((c, self.special[c]) for c in chunks if c in self.special)

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.chunks(t) for t in texts]
        if len(self.young) > KEPT_WORDS:
            self.old, self.young = self.young, {}
        missing = set(chain.from_iterable(split)).difference(self.young)
        self.young.update((c, self.old[c]) for c in missing.intersection(self.old))
        self._learn(missing.difference(self.young))
        get = self.young.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]


def bpe_encode(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int> and decoded string of every row."""
    shared = Shared(docs.sparkSession, Vocabulary(tokenizer_path))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.get()
        encoder = Encoder(vocabulary)
        for batch in batches:
            for start, run_ in text_runs(batch.column(1), SLICE_BYTES):
                texts = ["" if t is None else t for t in run_.to_pylist()]
                coded = encoder.encode(texts)
                ends = np.r_[0, np.cumsum([len(x) for x in coded])].astype(np.int32)
                flat = np.fromiter(chain.from_iterable(coded), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([vocabulary.decode(x) for x in coded], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def summary(coded: DataFrame) -> DataFrame:
    """One flat row per document from `bpe_encode`."""
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
