"""Token ids by a public tokenizer's file, in Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re

import pyarrow as pa

#: Characters below U+0250 have been in the same classes (letter, number, space) in all versions of Unicode that the two
#: libraries' pattern engines use; only texts made of these take the faster library.
_BEYOND = re.compile("[^\u0000-ɏ]")
#: The faster library's pattern engine needs stack for each character of a run of white space, and fails at some 700,000. Texts
#: longer than LONG_TEXT that have a run of LONG_RUN go to the other library.
LONG_TEXT, LONG_RUN = 1 << 17, 1000
_SPACES = re.compile(rf"\s{{{LONG_RUN}}}")


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_of_char() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """encode(texts): the ids that the library for the file gives, without added special tokens.

    For a byte-level BPE in JSON, if beside it lies a .tiktoken file whose ranks are shown here to be the same vocabulary and
    merges, texts without special strings, of characters below U+0250 and without very long runs of white space are encoded from
    the ranks, about four times as fast; the tests hold both against each other. All others go to `tokenizers`.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.fast = None
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.slow = lambda texts: pieces.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        self.slow = lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
        ranks_file = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_file):
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            if self._same(spec, ranks):
                import tiktoken

                pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
                self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
                self.special = [t["content"] for t in spec["added_tokens"]]

    @staticmethod
    def _same(spec: dict, ranks: dict[bytes, int]) -> bool:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            return False
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec["added_tokens"]):
            return False
        byte, special = _byte_of_char(), {t["content"] for t in spec["added_tokens"]}
        vocab = {bytes(byte[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ", 1)) for m in model["merges"]]
        return vocab == ranks and all(model["vocab"][m] == 256 + i for i, m in enumerate(merged))

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return self.slow(texts)
        out: list[list[int] | None] = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if (not text.isascii() and _BEYOND.search(text)) or any(s in text for s in self.special) or (len(text) > LONG_TEXT and _SPACES.search(text)):
                rest.append(i)
            else:
                out[i] = self.fast.encode_ordinary(text)
        if rest:
            for i, ids in zip(rest, self.slow([texts[i] for i in rest])):
                out[i] = ids
        return out


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it is loaded once."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def texts_of(column: pa.Array, most: int = 1 << 20):
    """(first row, texts) in lots of about `most` characters; null counts as empty."""
    lot, first, size = [], 0, 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        lot.append(text)
        size += len(text)
        if size >= most or len(lot) >= 512:
            yield first, lot
            lot, first, size = [], i + 1, 0
    if lot:
        yield first, lot
