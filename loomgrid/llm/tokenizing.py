"""Texts to token ids by the tokenizers library, for any tokenizer file.

A tokenizer that drops white space, lower-cases and splits letters from signs
(``_SHORT_WAY`` says just how) is asked for distinct words only; every other one
gets whole texts. The loaded tokenizer decides, not its file's name.

Defined results: null texts are empty; ids are those of
``encode(text, add_special_tokens=False)``, special tokens included where a text
holds their strings.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

from . import textbytes as tb
from .chunk_table import WordTable

# The normalizer and the splitting that WordEncoder stands for.
_SHORT_WAY = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}
#: Whole texts go to the library in groups of so many bytes.
_GROUP_BYTES = 256 << 10


def load(tokenizer_path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


def _own_letters() -> str:
    """Letters up to U+024F that the normalizer maps to one letter each, whatever stands beside them."""
    return "".join(c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and c.lower().isalpha())


#: The ASCII signs but the apostrophe (it begins endings like 's) and what special tokens begin with.
_SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in "'<")
_SIGNED = "([" + re.escape(_SIGNS) + "]*)"
#: A word of letters between signs.
_ASCII = re.compile((_SIGNED + "([A-Za-z]+)" + _SIGNED).encode())
_WORD = re.compile(_SIGNED + "([" + _own_letters() + "]+)" + _SIGNED)
#: Byte-level vocabularies show each byte as a character: printable Latin-1 ones as they are, the others from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Runs of signs and words that are kept with their ids.
_RUNS, _WORDS = 10_000, 500_000


class WordEncoder:
    """White-space separated chunks to ids by the tokenizers library.

    The tokenizer splits at every change between letters and signs, so a word
    between signs is up to three parts. The word goes straight to the library's
    model, as there is nothing to normalize or split in such letters but their
    case; runs of signs, of which there are few, are asked for once. Any other
    chunk goes through the library whole.
    """

    def __init__(self, tokenizer_path: str):
        self.tokenizer = load(tokenizer_path)
        self.model = self.tokenizer.model
        self.runs: dict[str | bytes, list[int]] = {}

    def _run(self, signs: str | bytes) -> list[int]:
        if signs not in self.runs:
            if len(self.runs) >= _RUNS:
                self.runs.clear()
            self.runs[signs] = self.whole(signs)
        return self.runs[signs]

    def whole(self, chunk: str | bytes) -> list[int]:
        return self.tokenizer.encode(chunk if isinstance(chunk, str) else chunk.decode(), add_special_tokens=False).ids

    def __call__(self, chunks: list[bytes]) -> list[list[int]]:
        out, tokenize = [], self.model.tokenize
        for chunk in chunks:
            if m := _ASCII.fullmatch(chunk):
                head, word, tail = m.groups()
                ids = [t.id for t in tokenize(word.lower().decode())]
            elif m := _WORD.fullmatch(chunk.decode()):
                head, word, tail = m.groups()
                ids = [t.id for t in tokenize(word.lower().encode().decode("latin-1").translate(_SHOWN))]
            else:
                out.append(self.whole(chunk))
                continue
            if head or tail:
                ids = (self._run(head) if head else []) + ids + (self._run(tail) if tail else [])
            out.append(ids)
        return out


def _is_short_way(tokenizer) -> bool:
    """Whether words may be asked for alone: same normalizer and splitting, and special tokens that all begin with ``<|`` and are matched as written."""
    made = json.loads(tokenizer.to_str())
    added = made.get("added_tokens") or []
    return all(made.get(k) == v for k, v in _SHORT_WAY.items()) and all(t["content"].startswith("<|") and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)


class Encoder:
    """Columns of texts to ids."""

    def __init__(self, tokenizer_path: str):
        self.tokenizer = load(tokenizer_path)
        self.table = WordTable(WordEncoder(tokenizer_path), most=_WORDS) if _is_short_way(self.tokenizer) else None

    def column(self, column: pa.Array, tail: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text), each text followed by ``tail``."""
        if self.table is None:
            return self._whole(column, tail)
        data, off = tb.column_bytes(column)
        special = (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # <|
        return self.table.words(data if special.any() else tb.LOWER[data], off, tail)  # lower-cased before, the table has fewer words

    def _whole(self, column: pa.Array, tail: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        _, off = tb.column_bytes(column)
        texts, parts, sizes, at = [t or "" for t in column.to_pylist()], [], [], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(off, off[at] + _GROUP_BYTES, "right")) - 1)
            for e in self.tokenizer.encode_batch_fast(texts[at:to], add_special_tokens=False):
                parts.append(np.array([*e.ids, *tail], np.int32))
                sizes.append(len(parts[-1]))
            at = to
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_path: str) -> Encoder:
    """A Python worker keeps its encoder, and so its table of words, from task to task."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = Encoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def id_bytes(tokenizer_path: str, *more: int) -> int:
    """Bytes that any id of the tokenizer, and ``more``, fits in: 2 or 4."""
    return 2 if max([*load(tokenizer_path).get_vocab(with_added_tokens=True).values(), *more]) < 1 << 16 else 4
