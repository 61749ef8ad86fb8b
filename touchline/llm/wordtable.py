"""Byte-pair encoding and decoding through a table of distinct words.

Documents are split into words in Spark. A run of documents (a chunk) refers to its distinct words by number, so what
moves is each chunk's list of words and one compressed array of numbers for each document. The lists meet by parts of
the word table, where each distinct word of the corpus is encoded once; its ids are joined back to the chunks and with
their pieces, and put in place by position.
"""
from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.textscan import Flat, blocks
from touchline.llm.tokens import CLASSES, DIGIT, FOREIGN, LETTER, OTHER, is_plain

CHUNK_CHARS = 1 << 23
#: Parts of the word table; a task holds the distinct words of one.
PARTS = 256


class Splitter:
    """Words of texts exactly as the tokenizer file's normaliser and pre-tokenizer cut them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cut_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def foreign(self, text: str) -> list[str]:
        """Words of a text the array rules don't cover, by the library's own steps."""
        out: list[str] = []
        for part in self.cut_specials.split(text) if self.cut_specials else [text]:
            if part in self.specials:
                out.append(part)
            elif part:
                t = self.tokenizer
                normal = t.normalizer.normalize_str(part) if t.normalizer else part
                out += [normal[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Flat]:
        """Hash, start and end of the words of plain texts, and the lower-cased text itself: runs of letters, single
        digits, runs of other signs."""
        flat = Flat([t.lower() for t in texts])
        kind = CLASSES[flat.cp]
        kind[flat.starts[1:] - 1] = FOREIGN
        begins = np.ones(len(kind), dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(kind))
        word = np.isin(kind[start], (LETTER, DIGIT, OTHER))
        start, end = start[word], end[word]
        return flat.hashes(start, end), start, end, flat


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


class Chunk:
    """Consecutive documents as numbers of their distinct words."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.known, self.code = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.words: list[str] = []
        self.ids: list = []
        self.codes: list[np.ndarray] = []

    def numbers(self, hashes: np.ndarray, word_at) -> np.ndarray:
        """The number of each word, by first occurrence; ``word_at(i)`` gives the string of an unseen one."""
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        new = place == len(self.known)
        new[~new] = self.known[place[~new]] != distinct[~new]
        if new.any():
            known = np.concatenate((self.known, distinct[new]))
            code = np.concatenate((self.code, np.arange(len(self.words), len(self.words) + int(new.sum()))))
            order = np.argsort(known)
            self.known, self.code = known[order], code[order]
            self.words += [word_at(i) for i in first[new]]
        return self.code[np.searchsorted(self.known, distinct)][back]

    def finish(self) -> None:
        """Number the words by falling frequency, which makes most numbers small."""
        lengths = np.cumsum([len(c) for c in self.codes])[:-1]
        all_codes = np.concatenate(self.codes) if self.codes else np.zeros(0, dtype=np.int64)
        order = np.argsort(-np.bincount(all_codes, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.words = [self.words[i] for i in order]
        self.codes = np.split(rank[all_codes], lengths) if self.codes else []


def _as_text(docs: DataFrame) -> DataFrame:
    """doc_id (as text, since next to a null it would turn into a float in a worker) and text."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def _chunks(batches: Iterator[pd.DataFrame], path: str, chunk_chars: int) -> Iterator[Chunk]:
    """The finished chunks of a partition, in order."""
    split, partition, made = splitter(path), TaskContext.get().partitionId(), 0
    chunk = Chunk(partition << 32)
    for batch in batches:
        texts = [t if isinstance(t, str) else "" for t in batch["text"]]
        ids = batch["doc_id"].tolist()
        for a, b in blocks(texts):
            block, out = texts[a:b], [np.zeros(0, dtype=np.int64)] * (b - a)
            plain = [i for i, t in enumerate(block) if t and is_plain(t, split.specials)]
            if plain:
                h, s, e, flat = split.words([block[i] for i in plain])
                cp = flat.cp
                code = chunk.numbers(h, lambda i: cp[s[i] : e[i]].tobytes().decode("utf-32-le")) if len(h) else np.zeros(0, dtype=np.int64)
                bounds = np.searchsorted(s, flat.starts)
                for i, x, y in zip(plain, bounds[:-1], bounds[1:]):
                    out[i] = code[x:y]
            for i in set(range(b - a)).difference(plain):
                words = split.foreign(block[i])
                if words:
                    flat = Flat(words)
                    out[i] = chunk.numbers(flat.hashes(flat.starts[:-1], flat.starts[1:] - 1), words.__getitem__)
            chunk.chars += sum(map(len, block))
            chunk.ids += ids[a:b]
            chunk.codes += out
            if chunk.chars >= chunk_chars:
                made += 1
                chunk.finish()
                yield chunk
                chunk = Chunk((partition << 32) + made)
    if chunk.ids:
        chunk.finish()
        yield chunk


def _packed(codes: np.ndarray) -> bytes:
    """Word numbers as compressed byte planes: the high bytes of frequent words' small numbers are all alike."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 4)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def document_codes(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row a document: its chunk, doc_id, compressed word numbers and how many words the chunk has."""

    def run(batches):
        for chunk in _chunks(batches, path, chunk_chars):
            yield pd.DataFrame({"chunk": chunk.number, "doc_id": chunk.ids, "codes": [_packed(c) for c in chunk.codes], "n_words": len(chunk.words)})

    return _as_text(docs).mapInPandas(run, "chunk long, doc_id string, codes binary, n_words long")


def chunk_words(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, parts: int = PARTS) -> DataFrame:
    """The distinct words of each chunk, one row for each part (by a hash of the word) of the word table: the words in
    order, joined by newlines, and their numbers."""

    def run(batches):
        for chunk in _chunks(batches, path, chunk_chars):
            words = np.array(chunk.words, dtype=object)
            flat = Flat(chunk.words)
            part = (flat.hashes(flat.starts[:-1], flat.starts[1:] - 1) % np.uint64(parts)).astype(np.int64) if len(words) else np.zeros(0, dtype=np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                codes = order[bounds[p] : bounds[p + 1]]
                if len(codes):
                    codes = codes[np.argsort(words[codes])]
                    rows.append((chunk.number, p, zlib.compress("\n".join(words[codes]).encode()), _packed(codes)))
            yield pd.DataFrame(rows, columns=["chunk", "part", "words", "codes"])

    return _as_text(docs).mapInPandas(run, "chunk long, part int, words binary, codes binary")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``words`` with their ids in place of the words: how many each has, and all of them in order.

    The rows of a part of the word table come together, one for each chunk, so each distinct word of the corpus is
    encoded once; a task holds the distinct words of one part. The words are already normalised.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.normalizer = None
        part, known = None, {}
        for batch in batches:
            out = []
            for chunk, p, packed, codes in batch.itertuples(index=False):
                if p != part:
                    part, known = p, {}
                mine = zlib.decompress(packed).decode().split("\n")
                new = [w for w in mine if w not in known]
                for w, x in zip(new, t.encode_batch(new, add_special_tokens=False)):
                    known[w] = np.array(x.ids, dtype="<u4").tobytes()
                ids = [known[w] for w in mine]
                count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
                out.append((chunk, codes, _packed(count), _packed(np.frombuffer(b"".join(ids), dtype="<u4"))))
            yield pd.DataFrame(out, columns=["chunk", "codes", "counts", "ids"])

    return words.repartition("part").sortWithinPartitions("part").mapInPandas(run, "chunk long, codes binary, counts binary, ids binary")


def vocabulary(path: str) -> dict[int, str]:
    """Piece of each id: as many as the tokenizer file has, whatever the corpus."""
    t = splitter(path).tokenizer
    pieces = ((i, t.id_to_token(i)) for i in range(t.get_vocab_size(True)))
    return {i: p for i, p in pieces if p is not None}


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (any columns and ids array<int>, no two rows alike) with the decoded text, by a join on the id.

    The text is the pieces with one blank between them, as a file without a decoder says. Unknown ids are left out; null
    or empty ids give the empty text. Long documents' ids are spread over rows, then meet again by document.
    """
    pieces = encoded.sparkSession.createDataFrame(list(vocabulary(path).items()), "id int, piece string")
    rows = encoded.withColumn("row", F.monotonically_increasing_id())
    one = rows.select("row", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces), "id")
    text = one.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("all")).select("row", F.array_join("all.piece", " ").alias("decoded"))
    return rows.join(text, "row", "left").withColumn("decoded", F.coalesce("decoded", F.lit(""))).drop("row")


def encode_decode(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, ids and decoded text of every document, equal to the library's encode and decode of the whole text.

    ``docs`` needs doc_id and text; further columns are ignored; null ids and repeated rows come back as they are. A
    null, empty or white-space text has no ids and decodes to the empty text. An empty table gives no rows. ``docs`` is
    read twice and must give the same partitions both times, as a table does; the words of each chunk are counted both
    times and a difference raises an error. A chunk's words are joined with their ids by number, and its distinct words
    with the pieces of their ids (the tokenizer's own vocabulary, of fixed size, which every task holds); documents are
    then put together by position. A task holds one chunk of ``chunk_chars`` characters, or one longer document.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def rebuild(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n_words = int(left["n_words"].iloc[0]) if len(left) else -1
        count, ids = np.zeros(max(n_words, 0), dtype=np.int64), [b""] * max(n_words, 0)
        filled = 0
        for codes, counts, packed in zip(right["codes"], right["counts"], right["ids"]):
            codes, counts, mine = _unpacked(codes), _unpacked(counts).astype(np.int64), _unpacked(packed).tobytes()
            filled += len(codes)
            if filled > n_words:
                break
            count[codes] = counts
            stop = np.cumsum(counts)
            for c, b, n in zip(codes.tolist(), stop.tolist(), counts.tolist()):
                ids[c] = mine[4 * (b - n) : 4 * b]
        if filled != n_words:
            raise RuntimeError("the documents were dealt to partitions in another way the second time; give a stored table")
        store = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
        first = np.cumsum(count) - count
        piece = pieces.value
        names = [piece[i] for i in store.tolist()]
        decoded = [" ".join(names[a : a + n]) for a, n in zip(first.tolist(), count.tolist())]
        del names, ids
        out_ids, out_text = [], []
        for packed in left["codes"]:
            codes = _unpacked(packed)
            n = count[codes]
            stop = np.cumsum(n)
            out_ids.append(store[np.arange(stop[-1]) + np.repeat(first[codes] - (stop - n), n)] if len(codes) else np.zeros(0, dtype=np.int32))
            out_text.append(" ".join([decoded[c] for c in codes.tolist()]))
        return pd.DataFrame({"doc_id": left["doc_id"], "ids": pd.Series(out_ids, dtype=object), "decoded": pd.Series(out_text, dtype=object)})

    coded = document_codes(docs, path, chunk_chars)
    known = encode_words(chunk_words(docs, path, chunk_chars), path)
    out = coded.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(rebuild, "doc_id string, ids array<int>, decoded string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and checksums in place of ids and text."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
