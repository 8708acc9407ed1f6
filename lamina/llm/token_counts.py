"""Token counts of whole texts, as a public tokenizer's library gives them."""

from __future__ import annotations

import itertools
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, arrow_pass

#: Bytes of text that one call of the library gets.
CALL_BYTES = 1 << 18
#: Bytes of counts kept by piece in a worker, and the longest piece whose count is kept.
KEPT_BYTES, KEPT_CHARS = 32 << 20, 48
#: Characters from which a piece is split further.
LONG_CHARS = 4_096
#: A space with no white space beside it, or at an end of the text.
_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"^ |\s |  | \s| $")
#: Where a byte-level file's pattern ends a token in any case: after a letter and before a character that is none. Both sides are a
#: safe choice of such characters.
_ENDS = re.compile(r"(?<=[A-Za-z\u0430-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3])(?=[\n,.;:!?()\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")


def resolve(name: str) -> str:
    """The path itself, or the place of the public file of that name."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def utf8(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


class Counter:
    """Counts tokens by the library's batch encoding.

    A text is split before a single space between two characters that aren't white space, if the tokenizer
    puts a token's end at every such place: then the counts of the pieces add up to the text's. Equal pieces are encoded
    once. Pieces of more than LONG_CHARS characters are split further, for byte-level files, between a letter and a mark of
    punctuation. Calls get pieces of about CALL_BYTES bytes together, so a long text costs no more memory than short ones;
    a stretch without either is encoded whole, whatever its length."""

    def __init__(self, name: str):
        path = resolve(name)
        if path.endswith(".json"):
            import json

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            with open(path) as f:
                spec = json.load(f)
            pre = spec.get("pre_tokenizer") or {}
            self.parts = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(" " in x["content"] or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", []))
            self.space, self.specials = " ", [x["content"] for x in spec.get("added_tokens", [])]
            self.lengths = lambda texts: [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
            inner = any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
            self.parts = not inner and all(sp.encode(f"{a} {b}") == sp.encode(a) + sp.encode(b) for a, b in (("a", "b"), ("über", "Σ"), ("1,", "中"), ("x.", "(y")))
            self.space, self.specials = "", None
            self.lengths = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"{path}: a .json or a .model file is asked for")
        self.kept: dict[str, int] = Kept(KEPT_BYTES)

    def split(self, text: str) -> list[str]:
        """Pieces; all but the first follow a space that isn't in them."""
        if not self.parts or " " not in text:
            return [text]
        return _SPACE.split(text) if _ODD.search(text) else text.split(" ")

    def count(self, texts: list[str]) -> list[int]:
        first, rest = [], []
        for text in texts:
            head, *tail = self.split(text)
            first.append(head)
            rest.append(tail)
        kept = self.kept
        kept.room()
        new = [x for x in set(itertools.chain.from_iterable(rest)).difference(kept)]
        found = dict(zip(new, self._encode([self.space + x for x in new]), strict=True))
        heads = self._encode(first)
        out = []
        if any(len(x) > KEPT_CHARS for x in new):
            kept.add({k: v for k, v in found.items() if len(k) <= KEPT_CHARS})
            get = lambda x: kept[x] if x in kept else found[x]
        else:
            kept.add(found)
            get = kept.__getitem__
        for n, tail in zip(heads, rest, strict=True):
            out.append(n + sum(map(get, tail)))
        return out

    def _encode(self, pieces: list[str]) -> list[int]:
        """Each piece's tokens, long ones in parts. No special string is cut: a piece that has one stays whole."""
        if self.specials is None or not self.parts or not any(len(x) > LONG_CHARS for x in pieces):
            return self._calls(pieces)
        parts = [[x] if len(x) <= LONG_CHARS or any(y in x for y in self.specials) else _ENDS.split(x) for x in pieces]
        counts = iter(self._calls(list(itertools.chain.from_iterable(parts))))
        return [sum(itertools.islice(counts, len(x))) for x in parts]

    def _calls(self, pieces: list[str]) -> list[int]:
        """Calls balanced by bytes; the order is that of pieces."""
        out: list[int] = []
        call: list[str] = []
        size = 0
        for x in pieces:
            own = utf8(x)
            if call and size + own > CALL_BYTES:
                out += self.lengths(call)
                call, size = [], 0
            call.append(x)
            size += own
        return out + (self.lengths(call) if call else [])


@lru_cache(maxsize=2)
def counter(name: str) -> Counter:
    """One for each worker process."""
    return Counter(name)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    A null text counts as empty (0, 0, false); null ids are kept; repeated rows give a row each; an empty table
    gives no rows; other columns are left out, whatever their names. Special strings in a text count as the library's default has it."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = counter(tokenizer)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        sizes = list(map(utf8, texts))
        out, part, size = [], [], 0
        for x, n in zip(texts, sizes, strict=True):
            part.append(x)
            size += n
            if size > 4 * CALL_BYTES:
                out += own.count(part)
                part, size = [], 0
        out += own.count(part) if part else []
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    counts = arrow_pass(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), per_batch, f"id {kind}, n_bytes long, n_tokens long")
    return counts.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
