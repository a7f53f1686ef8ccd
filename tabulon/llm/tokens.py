"""Token counts by heap-and-linked-list byte-pair merging, and token ids for packing."""

from __future__ import annotations

import heapq
import json
import operator
import os
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from itertools import compress, repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import Memo, words_of

#: White space as the vocabulary's pattern understands it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[L]+|[N]|[^SLN]+"
KNOWN = regex.compile(PATTERN.replace("L", r"\p{L}").replace("N", r"\p{N}").replace("S", SPACE)).findall
#: From here on lie the scripts that Unicode added after version 16.
FIRST_UNKNOWN = "\U000323b0"
#: Longer chunks are not kept in the memo.
KEPT_CHARS = 48
#: Chunks, and pieces, of the generation of token ids that is being filled.
MOST_YOUNG = 300_000
#: Pieces that are encoded as one text.
PIECES_AT_ONCE = 200
#: ASCII characters other than letters, which a chunk is stripped of.
MARKS = "".join(c for c in map(chr, range(0x21, 0x80)) if not c.isalpha())
MARK_BYTES = MARKS.encode()


@cache
def newer() -> tuple:
    """A search for letters and numbers that the regex library knows but the character
    tables of the vocabulary's library do not yet; and the pattern without them."""
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF)
    unknown = {k: "".join(c for c in regex.findall(rf"\p{{{k}}}", every) if c >= FIRST_UNKNOWN and unicodedata.category(c) == "Cn") for k in "LN"}
    found = regex.compile(f"[{unknown['L']}{unknown['N']}]" if any(unknown.values()) else r"(?!)").search
    letters, numbers = (rf"\p{{{k}}}--[{regex.escape(v)}]" if v else rf"\p{{{k}}}" for k, v in unknown.items())
    careful = "(?V1)" + PATTERN.replace("^SLN", rf"^{SPACE}[{letters}][{numbers}]").replace("[L]", f"[{letters}]").replace("[N]", f"[{numbers}]")
    return found, regex.compile(careful).findall


def pieces_of(text: str) -> list[str]:
    """The pieces of a normalised text that are merged on their own."""
    if text.isascii():
        return KNOWN(text)
    found, careful = newer()
    return careful(text) if found(text) else KNOWN(text)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: a
    printable byte for itself, the others from code point 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class BytePairs:
    """Counts tokens; ``vocabulary`` is a tokenizers file of lower-casing word BPE."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letters = byte_letters()
        self.of_piece = Memo(self.count_piece)
        self.of_chunk = Memo(self.count_chunk)

    def count_piece(self, piece: str) -> int:
        """Initial symbols minus merges of one piece.

        Symbols form a linked list. The heap holds adjacent pairs by rank, then by
        place; a popped pair counts only if what stands at its place still merges into
        the same symbol.
        """
        symbols = [self.letters[b] for b in piece.encode()]
        symbols[-1] += self.suffix
        n = len(symbols)
        ranks, after, before = self.ranks, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p[0] + p[1]) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in ranks]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, merged = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != merged or (symbols[i], symbols[j]) not in ranks:
                continue
            symbols[i], symbols[j] = merged, ""
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := (symbols[i], symbols[k])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, p[0] + p[1]))
            if (h := before[i]) >= 0 and (p := (symbols[h], symbols[i])) in ranks:
                heapq.heappush(heap, (ranks[p], h, p[0] + p[1]))
        return left

    def count_plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return sum(self.of_piece[p] if len(p) <= KEPT_CHARS else self.count_piece(p) for p in pieces_of(text))

    def count_chunk(self, chunk: str) -> int:
        if chunk.isascii() and chunk.isalpha():
            low = chunk.lower()
            return self.of_piece[low] if len(low) <= KEPT_CHARS else self.count_piece(low)
        if self.cut is None or "<" not in chunk:
            return self.count_plain(chunk)
        parts = self.cut.split(chunk)
        return len(parts) - 1 + sum(map(self.count_plain, parts))

    def count(self, text: str) -> int:
        """Tokens of a whole text. No token crosses white space, so that the text is
        counted chunk by chunk."""
        chunks = words_of(text)
        if len(text) > KEPT_CHARS and max(map(len, chunks), default=0) > KEPT_CHARS:
            return sum(self.of_chunk[c] if len(c) <= KEPT_CHARS else self.count_chunk(c) for c in chunks)
        return sum(map(self.of_chunk.__getitem__, chunks))


@cache
def byte_pairs(vocabulary: str) -> BytePairs:
    return BytePairs(vocabulary)


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Number of tokens (long) of a text column; a null text is empty.

    Only counts leave the tasks, no identifiers. ``vocabulary`` is a path that every
    executor can read. Texts are counted whole, whatever their length.
    """
    path = vocabulary or default_vocabulary()

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs = byte_pairs(path)
        for texts in batches:
            yield pd.Series([pairs.count(t) if t else 0 for t in texts], dtype="int64")

    return count(text)


def count_tokens(df: DataFrame, text_col: str = "text", vocabulary: str | None = None, limit: int = 2048) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` (long) and ``over_limit``; same-named input columns are replaced."""
    text = F.col(f"`{text_col}`")
    kept = [f"`{c}`" for c in df.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    counted = df.select(*kept, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), token_count(text, vocabulary).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@lru_cache(100_000)
def pieces_of_marks(marks: str) -> tuple[str, ...]:
    return tuple(KNOWN(marks)) if marks else ()


def stripped(chunk: str) -> tuple[str, ...] | None:
    """The pieces of a chunk that is letters between ASCII marks, the letters as they are; else none.

    What an apostrophe before letters takes from them is left to the vocabulary's pattern, and so are special strings."""
    middle = chunk.strip(MARKS)
    if not middle.isalpha() or "<|" in chunk:
        return None
    before, _, after = chunk.partition(middle)
    return None if before.endswith("'") else (*pieces_of_marks(before), middle, *pieces_of_marks(after))


class TokenIds:
    """Little-endian 32-bit token ids of texts, by the ``tokenizers`` library.

    No token crosses white space, so that each distinct chunk is encoded once and
    kept; chunks are cut into the vocabulary's pieces first where these are known, which repeat more.
    Lower-case ASCII words are kept with the chunks. Of chunks and of pieces two generations are kept: once the younger one has ``MOST_YOUNG``
    it becomes the older one, and what is then still looked up comes back from there.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        # a task has one core; threads of its own would each keep memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Which ids end a piece, if the vocabulary marks that.
        self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values(), default=0), bool)
        if suffix and all(b + suffix in words for b in byte_letters()):
            self.ends[[i for w, i in words.items() if w.endswith(suffix)]] = True
        #: Whether a piece of lower-case ASCII letters goes to the merges as it is: no added token may lie in it.
        self.direct = suffix is not None and not any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.of_piece: dict[str, bytes] = {}
        self.of_chunk: dict[bytes, bytes] = {}
        self.old_piece: dict[str, bytes] = {}
        self.old_chunk: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of lower-case ASCII words. Their letters stand for themselves, so that they need only be merged."""
        if not self.direct:
            return self.encode_pieces([w.decode() for w in words])
        merged = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in merged(w.decode())]).tobytes() for w in words]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. Many are encoded as one text with blanks between them, which
        ids that end a piece divide again; where their number is not that of the pieces, each is encoded alone."""
        parts = [pieces[at : at + PIECES_AT_ONCE] for at in range(0, len(pieces), PIECES_AT_ONCE)]
        out: list[bytes] = []
        for part, ids in zip(parts, self.encode([" ".join(p) for p in parts])):
            stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(ids, "uint32")]) + 1)).tolist()
            if len(stops) == len(part) and stops[-1] == len(ids):
                out += [ids[a:b] for a, b in zip([0, *stops], stops)]
            else:
                out += self.encode(part)
        return out

    def learn(self, chunks: set[bytes]) -> None:
        """Make the ids of all ``chunks`` known, which the younger generation does not have."""
        if len(self.of_chunk) > MOST_YOUNG:
            self.old_chunk, self.of_chunk = self.of_chunk, {}
        if len(self.of_piece) > MOST_YOUNG:
            self.old_piece, self.of_piece = self.of_piece, {}
        known = chunks & self.old_chunk.keys()
        self.of_chunk.update((c, self.old_chunk[c]) for c in known)
        ended, cut, whole = {}, {}, {}
        for c in chunks - known:
            word = c.rstrip(MARK_BYTES)
            marks = c[len(word) :]
            if word.isalpha() and b"<|" not in marks:  # of bytes: ASCII letters only
                ended[c] = word.lower(), marks
                continue
            ascii = c.isascii()
            text = c.lower().decode() if ascii else c.decode("utf-8", "surrogatepass")
            if pieces := stripped(text):
                cut[c] = pieces
            elif ascii and "<|" not in text:
                cut[c] = KNOWN(text)
            else:
                whole[c] = text
        words = {w for w, _ in ended.values()}.difference(self.of_chunk)
        known = words & self.old_chunk.keys()
        self.of_chunk.update((w, self.old_chunk[w]) for w in known)
        new = list(words - known)
        self.of_chunk.update(zip(new, self.encode_words(new)))
        marks = {m: pieces_of_marks(m.decode()) for m in {m for _, m in ended.values()}}
        pieces = set().union(*marks.values(), *cut.values()).difference(self.of_piece)
        known = pieces & self.old_piece.keys()
        self.of_piece.update((p, self.old_piece[p]) for p in known)
        for order, encode in ((list(pieces - known), self.encode_pieces), (list(set(whole.values())), self.encode)):
            for at in range(0, len(order), 20_000):
                part = order[at : at + 20_000]
                self.of_piece.update(zip(part, encode(part)))
        get = self.of_piece.__getitem__
        ends = {m: b"".join(map(get, ps)) for m, ps in marks.items()}
        for c, (w, m) in ended.items():
            self.of_chunk[c] = self.of_chunk[w] + ends[m]
        for c, ps in cut.items():
            self.of_chunk[c] = b"".join(map(get, ps))
        for c, text in whole.items():
            self.of_chunk[c] = get(text)
        for text in whole.values():
            self.of_piece.pop(text, None)

    def ids(self, texts: Iterable[str | bytes], words: int = 200_000) -> Iterator[bytes]:
        """The ids of each text (or its UTF-8 bytes), in order; texts are learnt in groups of about ``words`` words."""
        group: list[list[bytes]] = []
        size = 0
        for text in texts:
            raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
            group.append(raw.split())  # bytes split at the ASCII blanks
            size += len(group[-1])
            if size >= words:
                yield from self.flush(group)
                group, size = [], 0
        yield from self.flush(group)

    def flush(self, group: list[list[bytes]]) -> Iterator[bytes]:
        """One look-up a chunk; what is not known is learnt for the whole group and filled in."""
        get = self.of_chunk.get
        found = [list(map(get, chunks, repeat(b""))) for chunks in group]
        # the places of empty ids: what is not known yet
        gaps = {k: list(compress(range(len(parts)), map(operator.not_, parts))) for k, parts in enumerate(found) if not all(parts)}
        self.learn({group[k][i] for k, places in gaps.items() for i in places})
        for k, parts in enumerate(found):
            chunks = group[k]
            for i in gaps.get(k, ()):
                parts[i] = self.of_chunk[chunks[i]]
            yield b"".join(parts)


@cache
def token_ids(vocabulary: str) -> TokenIds:
    return TokenIds(vocabulary)
