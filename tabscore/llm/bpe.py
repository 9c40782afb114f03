"""BPE encoding and decoding: a backtracking encoder over Aho-Corasick matches.

Encoding a piece of text (a run the pre-tokenizer pattern yields):

* one walk of an Aho-Corasick automaton over the vocabulary gives the longest
  token from each end to the next; other positions are looked up when the
  search first reaches them;
* the encoder takes the longest token, and accepts it after its left
  neighbour only if the pair is compatible: merging the neighbours' bytes by
  rank would leave the boundary between them alone;
* otherwise it tries the next shorter token that is a prefix, and when none
  is left it steps back over the last token and marks the position as a dead
  end, so every position is left at most once and the pass stays linear.

The compatibility of a pair follows from undoing merges on both sides of the
boundary, newest first; answers are kept in a table.  The result equals merging
by rank.  Decoding gathers bytes through an offset table over one blob.

The vocabulary file is read once on the driver, its size is checked, and its
text is broadcast; every Python worker builds the tables once.  Texts are
encoded whole inside Arrow batches, with no shuffle, so a lost executor costs
a re-run of its tasks only.

Defined results: a null or empty text has no tokens and decodes to the empty
text; a special token's string in a text becomes that token, as the
tokenizers library does by default; repeated rows and ids are separate rows;
texts of any length are encoded whole; an empty table gives an empty result;
new columns get names that are free, the others come back as they were.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession

from tabscore.llm.common import python_workers, F, T, col, free_name

#: The broadcast vocabulary must stay below this.
VOCABULARY_BYTES = 16 * 1024 * 1024
#: Distinct pieces and pairs a worker remembers before it starts afresh (speed only, results do not depend on it).
REMEMBERED = 1 << 19

# Letters and numbers of Unicode versions after the one the
# tokenizers library knows (16); it sees them as neither.
LATER = ("\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
         "\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
         "\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f"
         "\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
         "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
         "\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
         "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
         "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
         "\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
         "\U000323b0-\U00033479\U0003d000-\U0003fc3f")

# The byte-level pre-tokenizer's pattern, white space being the
# Unicode property.
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{LATER}]]+| ?[\p{{N}}--[{LATER}]]+"
           rf"| ?[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{LATER}]]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# The same pattern for texts of Latin-1 characters alone.
_L1 = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N1 = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_S1 = r"\t-\r \x85\xa0"
LATIN_PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L1}]+| ?[{_N1}]+| ?[^{_S1}{_L1}{_N1}]+"
                 rf"|[{_S1}]+(?![^{_S1}])|[{_S1}]+")


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class OffsetTable:
    """Decoding: the bytes of all tokens in one blob, and where each begins."""

    def __init__(self, tokens: list[bytes]):
        self.offsets = np.zeros(len(tokens) + 1, dtype=np.int64)
        self.offsets[1:] = np.cumsum([len(t) for t in tokens])
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """Bytes gathered through the offset table; bytes that are not UTF-8 become U+FFFD."""
        ids = np.asarray(ids, dtype=np.int64)
        starts, ends = self.offsets[ids], self.offsets[ids + 1]
        sizes = ends - starts
        before = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)
        return self.blob[at].tobytes().decode("utf-8", errors="replace")


class Remembered(dict):
    """Piece of text -> its packed ids, worked out when first asked for; forgets all beyond ``REMEMBERED`` pieces."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


def token_list(spec: dict) -> list[bytes]:
    """The bytes of every token by id, special tokens included."""
    to_byte = byte_alphabet()
    tokens = {i: bytes(to_byte[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    tokens |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


class Vocabulary:
    """Tables of one byte-level BPE vocabulary (the JSON text of a tokenizers file).

    Ranks must follow ids (a token made by an earlier merge has the smaller
    id), as byte-level files of this kind do; anything else is refused.
    """

    def __init__(self, text: str):
        import ahocorasick
        import regex
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary is needed")
        if spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("prefix spaces, normalizers and ignored merges are not supported")
        tokens = token_list(spec)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        own = set(model["vocab"].values()) - set(self.special.values())
        size = len(tokens)
        self.id_of = {tokens[i]: i for i in own}
        self.pair_id: dict[int, int] = {}
        self.left = list(range(size))
        self.right = list(range(size))
        last = -1
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            ia, ib = model["vocab"][a], model["vocab"][b]
            made = model["vocab"][a + b]
            if made <= last or made <= max(ia, ib):
                raise ValueError("ids must follow the order of merges")
            last = made
            self.pair_id[ia << 32 | ib] = made
            self.left[made], self.right[made] = ia, ib
        # the longest shorter token that begins a token; -2 when there is none
        self.length = [len(t) for t in tokens]
        self.shorter = [-2] * size
        for b, i in self.id_of.items():
            for cut in range(len(b) - 1, 0, -1):
                if b[:cut] in self.id_of:
                    self.shorter[i] = self.id_of[b[:cut]]
                    break
        self.automaton = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.single = {b[0]: i for b, i in self.id_of.items() if len(b) == 1}
        if len(self.single) != 256:
            raise ValueError("every byte needs a token")
        self.pieces = regex.compile(PATTERN, regex.V1)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) \
            if self.special else None
        self.latin = re.compile(LATIN_PATTERN)
        self.pair_ok: dict[int, bool] = {}
        self.known = Remembered(self.piece)

    def compatible(self, a: int, b: int) -> bool:
        """Would merging by rank keep a boundary between tokens ``a`` and ``b``?"""
        key = a << 32 | b
        known = self.pair_ok.get(key)
        if known is None:
            if len(self.pair_ok) >= REMEMBERED:
                self.pair_ok.clear()
            known = self.pair_ok[key] = self._boundary_holds(a, b)
        return known

    def _boundary_holds(self, a: int, b: int) -> bool:
        # Walk back in time: undo the newer of the two tokens touching the
        # boundary.  A merge across the boundary happens if it ranks before
        # the merges not yet undone (on a tie the left one goes first).
        bound = float("inf")
        while True:
            across = self.pair_id.get(a << 32 | b)
            if across is not None and across < bound:
                return False
            undo_left = a > b
            for _ in range(2):
                if undo_left:
                    if self.right[a] != a:
                        bound, a = a, self.right[a]
                        break
                elif self.left[b] != b:
                    bound, b = b + 1, self.left[b]
                    break
                undo_left = not undo_left
            else:
                return True

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one piece of bytes.

        One walk of the automaton gives the longest token from each end to
        the next.  Where all neighbours are compatible that is the answer;
        else the search goes back from the first that are not.
        """
        text, known = data.decode("latin-1"), self.pair_ok.get
        greedy = [token for _, token in self.automaton.iter_long(text)]
        last, k = greedy[0], 1
        for token in greedy[1:]:
            fits = known(last << 32 | token)
            if fits is None:
                fits = self.compatible(last, token)
            if not fits:
                return self._backtracked(text, greedy, k)
            last = token
            k += 1
        return greedy

    def _backtracked(self, text: str, greedy: list[int], k: int) -> list[int]:
        """The exact tokens of a piece whose longest tokens fit up to the ``k``-th, which does not."""
        n = len(text)
        matches, known, length, shorter = self.automaton.iter_long, self.pair_ok.get, self.length, self.shorter
        longest: dict[int, int] = {}          # the longest token from a position, looked up when first needed
        at = 0
        for i, token in enumerate(greedy):
            if i == k:
                pos = at
            longest[at] = token
            at += length[token]
        dead = bytearray(n + 1)
        out, token = greedy[:k], shorter[greedy[k]]
        while pos < n:
            if token == -1:    # the place is new
                token = longest.get(pos, -1)
                if token < 0:
                    token = longest[pos] = next(matches(text, pos))[1]
            while token >= 0:
                end = pos + length[token]
                if not dead[end]:
                    fits = known(out[-1] << 32 | token) if out else True
                    if fits is None:
                        fits = self.compatible(out[-1], token)
                    if fits:
                        out.append(token)
                        pos, token = end, -1
                        break
                token = shorter[token]
            else:
                # dead end: no token fits here after this prefix
                dead[pos] = 1
                token = out.pop()
                pos -= length[token]
                token = shorter[token]
        return out

    def plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens."""
        try:
            text.encode("latin-1")
            pieces = self.latin.findall(text)
        except UnicodeEncodeError:
            pieces = self.pieces.findall(text)
        return b"".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.specials is None or not self.specials.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self.plain(text[at:m.start()]), np.asarray([self.special[m.group()]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join(out) + self.plain(text[at:])


_BUILT: dict[tuple, Vocabulary | OffsetTable] = {}


def _built(text: str, make) -> Vocabulary | OffsetTable:
    """The tables of a vocabulary text, built once per Python process."""
    key = (make.__name__, hashlib.sha256(text.encode()).hexdigest())
    if key not in _BUILT:
        _BUILT[key] = make(text)
    return _BUILT[key]


def vocabulary(text: str) -> Vocabulary:
    return _built(text, Vocabulary)


def _offset_table(text: str) -> OffsetTable:
    return OffsetTable(token_list(json.loads(text)))


def offset_table(text: str) -> OffsetTable:
    return _built(text, _offset_table)


def read_vocabulary(path: str) -> str:
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than the {VOCABULARY_BYTES} bytes that may be broadcast")
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encode_column(spark: SparkSession, path: str, text: Column) -> Column:
    """Ids of each text as one binary value (little-endian unsigned 32-bit integers)."""
    python_workers(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf(T.BinaryType())
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(shared.value)
        for batch in batches:
            yield pd.Series([v.encode(t) for t in batch], dtype=object)

    return ids(text)


def decode_column(spark: SparkSession, path: str, ids: Column) -> Column:
    """The text of each binary value of ids."""
    python_workers(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = offset_table(shared.value)
        for batch in batches:
            yield pd.Series([v.decode(np.frombuffer(b or b"", dtype="<u4")) for b in batch], dtype=object)

    return text(ids)


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (binary) and ``n_tokens`` appended (underscores follow a name that is taken)."""
    spark = docs.sparkSession
    ids, n = free_name(docs.columns, "token_ids"), free_name(docs.columns, "n_tokens")
    out = docs.withColumn(ids, encode_column(spark, path or default_path(), col(text)))
    return out.withColumn(n, F.call_function("div", F.octet_length(F.col(ids)), F.lit(4)))


def decode(encoded: DataFrame, path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded_text`` appended."""
    name = free_name(encoded.columns, "decoded_text")
    return encoded.withColumn(name, decode_column(encoded.sparkSession, path or default_path(), col(ids)))


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one Python pass: a task then holds one Python worker, not two at a time."""
    spark = docs.sparkSession
    python_workers(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(path or default_path()))
    both = free_name(docs.columns, "token_ids_and_text")
    returned = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("text", T.StringType())])

    @F.pandas_udf(returned)
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v, table = vocabulary(shared.value), offset_table(shared.value)
        for batch in batches:
            ids = [v.encode(t) for t in batch]
            yield pd.DataFrame({"ids": ids, "text": [table.decode(np.frombuffer(b, dtype="<u4")) for b in ids]},
                               dtype=object)

    taken = list(docs.columns)
    names = [free_name(taken, n) for n in ("token_ids", "n_tokens", "decoded_text")]
    out = docs.withColumn(both, encoded(col(text)))
    ids = F.col(both)["ids"]
    return out.select(*[col(c) for c in taken], ids.alias(names[0]),
                      F.call_function("div", F.octet_length(ids), F.lit(4)).alias(names[1]),
                      F.col(both)["text"].alias(names[2]))
