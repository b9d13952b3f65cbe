"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring bytes that never stand side by side inside any vocabulary token can
never be merged over, so the border between them is a certain cut.  A piece is cut
there, the fragments are encoded independently and their ids concatenated; that is
the whole piece's encoding, because no merge could have crossed a cut.

The rules (normalisation, piece pattern, merges, added tokens) come from a tokenizer
file in the JSON format of the tokenizers library.  The library itself is asked only
about characters that are newer than Python's Unicode tables.

Cases: null text is encoded as empty text (no ids); empty text has no ids and decodes
to empty text; ids that the file doesn't know are skipped in decoding; null ids decode
to null.  Repeated rows give repeated results.  Texts are never cut short: a fragment
of any length is merged with a heap, in n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quayline.llm.tables import map_batches, read_table

#: Words remembered per worker, and the longest that is remembered: bounds of a cache,
#: which only save work.
MOST_WORDS = 200_000
LONGEST_WORD = 48
#: Up to this many symbols a plain search for the best pair is faster than a heap.
SHORT = 40
#: Above any token id; above any rank and id in one number.
ID_SPACE = 1 << 22
NO_MERGE = 1 << 60

# The piece pattern of byte-level BPE files that name none.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes are themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + rest.index(b)) for b in range(256)]


class Remembered(dict):
    """A dictionary that makes what it misses and keeps what is short enough."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST_WORD:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > MOST_WORDS:
            self.clear()


class Pieces:
    """What comes before and after merging in one tokenizer file: added tokens,
    normalisation, cutting into pieces, decoding.  ``encode`` gives ids as little-endian
    unsigned 32-bit integers in one byte string, ``decode`` takes a sequence of ids."""

    def __init__(self, spec_text: str):
        spec = json.loads(spec_text)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("unk_token"):
            raise ValueError("only plain byte-level BPE files are understood")
        self._read_normalizer(spec.get("normalizer"))
        self._read_pieces(spec["pre_tokenizer"])
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
            raise ValueError("only added tokens that match literally are understood")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.letters = byte_letters()
        self._read_decoder(spec.get("decoder"), model["vocab"])
        self._read_model(model, spec_text)
        self.words = Remembered(self._encode_text)
        self.pieces = Remembered(self._encode_piece)

    def _read_normalizer(self, rule: dict | None) -> None:
        steps = [] if rule is None else rule.get("normalizers", [rule])
        self.nfc = self.lower = self.spaces = False
        for step in steps:
            if step["type"] == "NFC":
                self.nfc = True
            elif step["type"] == "Lowercase":
                self.lower = True
            elif step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " ":
                self.spaces = True
            else:
                raise ValueError(f"normalizer {step['type']} is not understood")

    def _read_pieces(self, rule: dict) -> None:
        steps = rule.get("pretokenizers", [rule])
        pattern = BYTE_LEVEL_PATTERN
        if steps[0]["type"] == "Split":
            if steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
                raise ValueError("only a Split that keeps what matches is understood")
            pattern = steps[0]["pattern"]["Regex"]
            steps = steps[1:]
        if len(steps) != 1 or steps[0]["type"] != "ByteLevel" or steps[0]["add_prefix_space"]:
            raise ValueError("only byte-level pieces without a prefix space are understood")
        self.rule = pattern
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # No piece holds white space: words between spaces can be encoded one by one.
        self.by_word = self.spaces and steps[0]["use_regex"] is False

    def _read_decoder(self, rule: dict | None, vocab: dict[str, int]) -> None:
        if rule is not None and rule["type"] != "ByteLevel":
            raise ValueError(f"decoder {rule['type']} is not understood")
        self.glue = b" " if rule is None else b""
        byte_of = {ord(c): b for b, c in enumerate(self.letters)}
        self.token_bytes = {
            i: t.encode() if rule is None else bytes(byte_of[ord(c)] for c in t) for t, i in vocab.items()
        } | {i: t.encode() for t, i in self.added.items()}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by_word:
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        return self._encode_text(text)

    def decode(self, ids) -> str:
        known = self.token_bytes
        try:
            parts = list(map(known.__getitem__, ids))
        except KeyError:
            parts = [known[i] for i in ids if i in known]
        return self.glue.join(parts).decode("utf-8", "replace")

    def trim(self) -> None:
        self.words.trim()
        self.pieces.trim()

    def _encode_text(self, text: str) -> bytes:
        if self.added_pattern is None or not any(t in text for t in self.added):
            return self._encode_plain(text)
        parts = self.added_pattern.split(text)
        return b"".join(
            self.added[p].to_bytes(4, "little") if k % 2 else self._encode_plain(p) for k, p in enumerate(parts)
        )

    def _encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            if any(unicodedata.category(c) == "Cn" for c in text):
                return self._encode_newer(text)
            if self.nfc:
                text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter, without the rule for a last sigma
        if self.by_word and text.isalpha():
            return self.pieces[text]  # letters alone are one piece
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def _encode_newer(self, text: str) -> bytes:
        """Characters that this Python's Unicode tables don't have yet: which of them
        are letters, and their lower case, is what the tokenizers library says."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        if self.nfc:
            text = normalizers.NFC().normalize_str(text)
        if self.lower:
            text = normalizers.Lowercase().normalize_str(text)
        pieces = pre_tokenizers.Split(Regex(self.rule), "removed", invert=True).pre_tokenize_str(text)
        return b"".join(self.pieces[p] for p, _ in pieces)


class Bpe(Pieces):
    """Merging by forced-boundary splitting."""

    def _read_model(self, model: dict, spec_text: str) -> None:
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # (left id, right id) -> rank and id of the merged token in one number
        self.merges = {(vocab[a], vocab[b]): rank * ID_SPACE + vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.inner = [vocab[c] for c in self.letters]
        self.last = [vocab[c + suffix] for c in self.letters]
        self.cuts = self._pairs_outside_tokens(vocab, {c: b for b, c in enumerate(self.letters)})

    @staticmethod
    def _pairs_outside_tokens(vocab: dict[str, int], byte_of: dict[str, int]) -> set[tuple[int, int]]:
        """The pairs of bytes that stand side by side inside no token."""
        joined = set()
        for token in vocab:
            got = [byte_of[c] for c in token if c in byte_of]  # a suffix adds pairs, which only means fewer cuts
            joined.update(zip(got, got[1:], strict=False))
        return {(a, b) for a in range(256) for b in range(256)} - joined

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        ids: list[int] = []
        start = 0
        for end in [k for k, pair in enumerate(zip(data, data[1:], strict=False), 1) if pair in self.cuts] + [len(data)]:
            fragment = symbols[start:end]
            ids += self._merge(fragment) if end - start <= SHORT else self._merge_long(fragment)
            start = end
        return array("I", ids).tobytes()

    def _merge(self, symbols: list[int]) -> list[int]:
        """Merge the best pair, the leftmost of equals, until none is left."""
        get = self.merges.get
        found = [get(pair, NO_MERGE) for pair in zip(symbols, symbols[1:], strict=False)]
        while found:
            best = min(found)
            if best == NO_MERGE:
                break
            at = found.index(best)
            symbols[at : at + 2] = [best % ID_SPACE]
            del found[at]
            if at:
                found[at - 1] = get((symbols[at - 1], symbols[at]), NO_MERGE)
            if at < len(found):
                found[at] = get((symbols[at], symbols[at + 1]), NO_MERGE)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list of symbols."""
        merges, n = self.merges, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[p] // ID_SPACE, k, merges[p] % ID_SPACE, p) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merges]
        heapq.heapify(heap)
        gone = -1
        while heap:
            _, k, made, pair = heapq.heappop(heap)
            right = after[k]
            if symbols[k] != pair[0] or right >= n or symbols[right] != pair[1]:
                continue  # one of the two has been merged meanwhile
            symbols[k], symbols[right] = made, gone
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n:
                    new = (symbols[left], symbols[after[left]])
                    if new in merges:
                        rank, into = divmod(merges[new], ID_SPACE)
                        heapq.heappush(heap, (rank, left, into, new))
        return [s for s in symbols if s != gone]


@lru_cache(maxsize=2)
def bpe(spec_text: str) -> Bpe:
    """The tokenizer of a file's text; a worker builds it once."""
    return Bpe(spec_text)


def read_spec(path: str) -> str:
    """The text of a tokenizer file; a few MB, sent to the tasks with the function."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def id_lists(parts: list[bytes]) -> pa.ListArray:
    """Encoded texts as one Arrow list column."""
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and ``ids array<int>`` of every row; other columns are left out."""
    spec = read_spec(tokenizer)

    def make():
        coder = bpe(spec)

        def one(batch: pa.RecordBatch) -> dict:
            coder.trim()
            return {id_col: batch.column(0), "ids": id_lists([coder.encode(t) for t in batch.column(1).to_pylist()])}

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, [id_col, text_col], f"`{id_col}` {kind}, ids array<int>", make)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column and ``text`` of every row of ids."""
    spec = read_spec(tokenizer)

    def make():
        coder = bpe(spec)

        def one(batch: pa.RecordBatch) -> dict:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            return {id_col: batch.column(0), "text": texts}

        return one

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded, [id_col, ids_col], f"`{id_col}` {kind}, text string", make)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text in one pass: ``n_tokens``, the SHA-256 of the ids
    (little-endian unsigned 32-bit) and of the decoded text (UTF-8), and on request
    the ``ids`` themselves."""
    spec = read_spec(tokenizer)

    def make():
        coder = bpe(spec)

        def one(batch: pa.RecordBatch) -> dict:
            coder.trim()
            counts, ids_digests, text_digests, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text)
                decoded = coder.decode(np.frombuffer(ids, "<u4").tolist())
                counts.append(len(ids) // 4)
                ids_digests.append(hashlib.sha256(ids).hexdigest())
                text_digests.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
            made = {id_col: batch.column(0), "n_tokens": counts, "ids_sha256": ids_digests, "decoded_sha256": text_digests}
            return made | {"ids": id_lists(all_ids)} if keep_ids else made

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_batches(docs, [id_col, text_col], schema, make)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
