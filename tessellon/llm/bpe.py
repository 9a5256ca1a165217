"""BPE encoding and decoding with a pair occurrence index.

All new words of a partition's batch are laid out in one symbol array. An index maps every mergeable pair to all
positions where it stands; active ranks are applied in ascending order from a heap, each at all its positions at
once, and only the lists of the neighbouring pairs are updated. This equals merging word by word, since a merge
can only create pairs of a higher rank (checked when the vocabulary is read).

Defined results: a null or empty text gives no ids (n_tokens 0, the digests of empty input); special tokens written
in a text become their own ids, as the library does by default; repeated rows give repeated results; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import sys
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm.common import WORD_PY

#: Words kept by each Python worker, and their characters; the cache starts anew beyond that, so memory stays bounded.
CACHE_WORDS, CACHE_CHARS = 800_000, 16_000_000
#: Documents whose new words are encoded together.
CHUNK = 2048
#: What may follow the letters of a plain word.
ENDS = ".,!?;:"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class PairIndexEncoder:
    """Encoder for one vocabulary file (BPE over byte-level symbols with an end-of-word mark)."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        self.normalise, self.split = lib.normalizer.normalize_str, lib.pre_tokenizer.pre_tokenize_str
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.merges: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            new = self.vocab[a + b]
            self.merges[self.vocab[a] << 20 | self.vocab[b]] = (rank, new)
            made.setdefault(new, rank)
        self.keys = {rank: key for key, (rank, _) in self.merges.items()}
        self.sorted_keys = np.array(sorted(self.merges), np.int64)
        self.sorted_ranks = np.array([self.merges[k][0] for k in self.sorted_keys.tolist()], np.int64)
        for key, (rank, new) in self.merges.items():
            for part in (key >> 20, key & 0xFFFFF):
                if made.get(part, -1) >= rank or made[new] != rank:
                    raise ValueError("a merge stands before the merge that makes its part; ranks can't be applied in order")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        # plain words: letters of ASCII and Latin-1 with end punctuation; everything else goes through the library's splitter
        self.latin = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        self.mapped = {c: self.split(chr(c))[0][0] for c in [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]}
        self.words = re.compile(WORD_PY).findall
        self.ids: dict[str, bytes] = {}
        self.said: dict[str, str] = {}
        self.blank: set[str] = set()
        self.chars = 0

    def parts(self, words: list[str]) -> list[list]:
        """The byte-level pieces of each word, in order; special tokens as ints."""
        low = "\n".join(words).lower().translate(self.mapped).split("\n")
        out: list[list] = []
        for word, easy in zip(words, low):
            head = word.rstrip(ENDS)
            if (head.isascii() and head.isalpha()) or self.latin(head):
                if len(head) == len(word):
                    out.append([easy])
                else:
                    out.append([easy.rstrip(ENDS), word[len(head) :]])
                continue
            own: list = []
            for bit in self.special_re.split(word) if self.special_re else [word]:
                if bit in self.special:
                    own.append(self.special[bit])
                elif bit:
                    own += [p for p, _ in self.split(self.normalise(bit))]
            out.append(own)
        return out

    def encode_pieces(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """All ids in a row and where each piece's ids start, by applying ranks in ascending order at all positions of their pairs."""
        import numpy as np

        vocab, end, merges, keys = self.vocab, self.end, self.merges, self.keys
        flat: list[int] = []
        for p in pieces:
            flat += [vocab[c] for c in p[:-1]]
            flat.append(vocab[p[-1] + end])
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, starts = len(flat), np.concatenate([[0], np.cumsum(size)])
        sym = np.array(flat, np.int64)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[starts[1:] - 1] = -1
        prv[starts[:-1]] = -1
        known, ranks = self.sorted_keys, self.sorted_ranks
        v_sym, v_nxt, v_prv = memoryview(sym), memoryview(nxt), memoryview(prv)  # the same memory, quick for single items
        index: dict[int, list] = {}  # rank: single positions and arrays of positions
        active: list[int] = []

        def add(at, pair):
            """Enter the positions whose pairs can merge."""
            slot = np.searchsorted(known, pair)
            slot[slot == len(known)] = 0
            ok = np.flatnonzero(known[slot] == pair)
            if not len(ok):
                return
            rank, at = ranks[slot[ok]], at[ok]
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(at, cut)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        def add_one(i, pair):
            if pair in merges:
                r = merges[pair][0]
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(i)

        at = np.flatnonzero(nxt >= 0)
        add(at, sym[at] << 20 | sym[at + 1])
        while active:
            rank = heapq.heappop(active)
            found, key = index.pop(rank), keys[rank]
            new, left, right = merges[key][1], key >> 20, key & 0xFFFFF
            many = sum(1 if isinstance(x, int) else len(x) for x in found)
            if many > 24 and left != right:
                at = np.concatenate([x if isinstance(x, np.ndarray) else [x] for x in found]) if len(found) > 1 else found[0]
                j = nxt[at]
                ok = (j >= 0) & (sym[at] == left) & (sym[j] == right)
                at, j = at[ok], j[ok]
                k = nxt[j]
                sym[at], sym[j], nxt[at] = new, -1, k
                more = k >= 0
                prv[k[more]] = at[more]
                h = prv[at]
                h = h[h >= 0]
                add(h, sym[h] << 20 | new)
                add(at[more], new << 20 | sym[k[more]])
                continue
            ones: list[int] = []
            for x in found:
                ones += [x] if isinstance(x, int) else x.tolist()
            if left == right:
                ones.sort()  # runs of one symbol merge from the left
            for i in ones:
                j = v_nxt[i]
                if j < 0 or v_sym[i] != left or v_sym[j] != right:
                    continue
                k, h = v_nxt[j], v_prv[i]
                v_sym[i], v_sym[j], v_nxt[i] = new, -1, k
                if h >= 0:
                    add_one(h, v_sym[h] << 20 | new)
                if k >= 0:
                    v_prv[k] = i
                    add_one(i, new << 20 | v_sym[k])
        alive = sym >= 0
        return sym[alive].tolist(), np.concatenate([[0], np.cumsum(alive)])[starts].tolist()

    def learn(self, words: list[str]) -> None:
        """Put the words into the cache."""
        parts = self.parts(words)
        pieces = list({p for ps in parts for p in ps if isinstance(p, str)})
        token = self.token
        raws, names = {i: i.to_bytes(4, "little") for i in self.special.values()}, {i: t for t, i in self.special.items()}
        if pieces:
            ids, starts = self.encode_pieces(pieces)
            raw = array("I", ids)
            if sys.byteorder == "big":
                raw.byteswap()
            raw, said = raw.tobytes(), [token[i] for i in ids]
            for p, s, e in zip(pieces, starts, starts[1:]):
                raws[p], names[p] = raw[4 * s : 4 * e], " ".join(said[s:e])
        for w, ps in zip(words, parts):
            if len(ps) == 1:
                self.ids[w], self.said[w] = raws[ps[0]], names[ps[0]]
            else:
                self.ids[w], self.said[w] = b"".join([raws[p] for p in ps]), " ".join([names[p] for p in ps])
                if not ps:
                    self.blank.add(w)
        gc.freeze()  # the cache isn't garbage; later collections needn't walk it

    def encode_batch(self, texts: list) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and what they decode to."""
        out = []
        for lo in range(0, len(texts), CHUNK):
            split = [self.words(t) if t else [] for t in texts[lo : lo + CHUNK]]
            seen = set().union(*split)
            new = seen - self.ids.keys()
            size = sum(map(len, new))
            if len(self.ids) + len(new) > CACHE_WORDS or self.chars + size > CACHE_CHARS:
                gc.unfreeze()
                for x in (self.ids, self.said, self.blank):
                    x.clear()
                new, size, self.chars = seen, sum(map(len, seen)), 0
            if new:
                self.learn(list(new))
                self.chars += size
            ids, said = self.ids.__getitem__, self.said.__getitem__
            for ws in split:
                if self.blank:
                    ws = [w for w in ws if w not in self.blank]
                out.append((b"".join(map(ids, ws)), " ".join(map(said, ws))))
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens' strings with spaces between; unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@lru_cache(maxsize=4)
def encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>, decoded string for each row of docs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                part = b.slice(lo, CHUNK)
                got = enc.encode_batch(part.column(1).to_pylist())
                ids = [np.frombuffer(i, dtype="<u4").astype("int32") for i, _ in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, type=pa.list_(pa.int32())), pa.array([d for _, d in got], type=pa.string())], names=[id_col, "ids", "decoded"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() reduced to digests where the ids are made."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        for b in batches:
            rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for lo in range(0, b.num_rows, CHUNK) for i, d in enc.encode_batch(b.column(1).slice(lo, CHUNK).to_pylist())]
            n, a, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
