"""Token ids of a public BPE vocabulary file, with each distinct word encoded once for each worker."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

#: Other characters than those whose normal form and lower case don't depend on their neighbours; texts that have
#: any take the library's own path.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-įı-ňŊ-ž]")
#: The vocabulary file's own split pattern (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words that a worker remembers.
REMEMBERED = 250_000
#: Characters of text whose words are looked up together.
RUN_CHARS = 6 << 20


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follows from 256."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in stays}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class _Words(dict):
    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids = self.find(word)
        return ids


def _ranks(path: str, letters: list[str]) -> tuple[dict[bytes, int], list[bytes]]:
    """(byte strings and their merge rank, id of each rank as bytes).  Byte 0xFF, which no text holds, ends a word."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, byte_of = model["end_of_word_suffix"], {c: b for b, c in enumerate(letters)}
    tokens = [c + end for c in letters] + letters + ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ranks = {bytes(byte_of[c] for c in t.removesuffix(end)) + b"\xff" * t.endswith(end): k for k, t in enumerate(tokens)}
    return ranks, [np.array(model["vocab"].get(t, 0), "<u4").tobytes() for t in tokens]


class WordEncoder:
    """ids of a text as little-endian unsigned 32-bit bytes, equal to encode(text, add_special_tokens=False).

    Words are merged by tiktoken over the same file's merges, which is faster for single words; texts with characters in OTHER,
    or what may be a special token, are encoded by tokenizers itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        ranks, ids = _ranks(path, _byte_letters())
        merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

        def find(word: str) -> bytes:
            if word.isalpha():
                return b"".join([ids[r] for r in merge(word.encode() + b"\xff")])
            pieces = PIECES.findall(word)
            if len(pieces) == 1:
                return b"".join([ids[r] for r in merge(pieces[0].encode() + b"\xff")])
            return b"".join([self.words[p] for p in pieces])

        self.words = _Words(find)

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def many(self, texts: list[str]) -> Iterator[bytes]:
        """ids of each text.  Each distinct word of a run of texts is looked up once, the rest is vectorised."""
        run, size = [], 0
        for t in texts:
            run.append(t)
            size += len(t)
            if size >= RUN_CHARS:
                yield from self._run(run)
                run, size = [], 0
        yield from self._run(run)

    def _run(self, texts: list[str]) -> Iterator[bytes]:
        plain = ["<|" not in t and not OTHER.search(t) for t in texts]
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pa.array([t if p else "" for t, p in zip(texts, plain)], pa.large_string())))
        coded = lists.flatten().dictionary_encode()
        ids = [self.words[w] for w in coded.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        first = np.cumsum(lengths) - lengths
        code = coded.indices.to_numpy()
        n = lengths[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])]
        edges = ends[lists.offsets.to_numpy()]
        for t, p, a, b in zip(texts, plain, edges[:-1].tolist(), edges[1:].tolist()):
            yield out[a:b].tobytes() if p else self.one(t)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
