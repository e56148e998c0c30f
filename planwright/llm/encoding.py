"""Byte-level BPE ids for whole texts, computed once per distinct word.

Within a byte-level vocabulary whose splitter never lets a piece cross white space (a piece may only
*start* with one space), a text whose white space comes as single characters splits exactly into
" word" and "\\nword" chunks, each encoded on its own.  Frequent chunks are looked up; a word of letters
alone is one piece, which the library's BPE model takes as it is; other chunks go through the library's
splitter, and a text with runs of white space, or white space at its ends, is encoded by it as a whole.
Vocabularies of another kind encode every text as a whole.

Special tokens' strings inside a text are ordinary text (``encode_special_tokens``, as the notes beside the
vocabulary files have it): "<|endoftext|>" is spelled out and never becomes the one id.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: A chunk that may be encoded on its own: a word, perhaps after one newline.
ALONE = re.compile(r"\n?\S+(\s\S+)*")
#: Chunks remembered by one worker, none of over LONGEST characters; beyond it the later half goes, results
#: are the same.  About 200 bytes each, 80 MB in all.
REMEMBER, LONGEST = 400_000, 64
#: Letters to every version of Unicode in use; words of them are one piece, and marks after them or digits begin another.
LATIN = "A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}"
ASCII_WORD, WORD, LINE = "^[A-Za-z]+$", f"^[{LATIN}]+$", f"^\n[{LATIN}]+$"
ENDED, CUT = f"([{LATIN}0-9])([.,]+)", "\x01"
STORE = "encoders"
_ENCODERS: dict[str, "Encoder"] = common.kept(STORE)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes of Latin-1 stand for themselves, others for 256 and on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def splits_at_spaces(definition: str) -> bool:
    """Whether a tokenizer is what the module's docstring says of byte-level ones."""
    d = json.loads(definition)
    splitter, model = d.get("pre_tokenizer") or {}, d.get("model") or {}
    return (
        d.get("normalizer") is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex") is True and not splitter.get("add_prefix_space")
        and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    )


def joined_by(texts: pa.Array, by: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), by)[0].as_py()


class Encoder:
    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.by_words = splits_at_spaces(definition)
        self.model = self.tokenizer.model
        self.letters = {b: c for b, c in byte_letters().items() if b != ord("\n")}  # newlines are put between words
        self.known: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.newline = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: pa.Array, prefix: str) -> list[bytes]:
        """Ids of words of letters, one piece each."""
        joined = joined_by(words, "\n")
        if joined.isascii():
            first = self.letters[ord(" ")] if prefix else ""
            spelled = (first + joined.replace("\n", f"\n{first}")).split("\n")
        else:
            spelled = (prefix + joined.replace("\n", f"\n{prefix}")).encode().decode("latin-1").translate(self.letters).split("\n")
        run = self.model.tokenize
        return [array("I", [t.id for t in run(w)]).tobytes() for w in spelled]

    def _learn(self, chunks: pa.Array, prefix: str) -> list[bytes | None]:
        """Ids of distinct chunks; None for those that do not stand alone."""
        out = np.full(len(chunks), None, object)
        rest = np.ones(len(chunks), bool)
        # " word", "\nword" (a newline is a piece of its own), and marks cut off the word before them
        for pattern, skip, of in ((ASCII_WORD, 0, prefix), (WORD, 0, prefix), (LINE, 1, "")):
            hit = rest & pc.match_substring_regex(chunks, pattern).to_numpy(zero_copy_only=False)
            if hit.any():
                rest &= ~hit
                words = chunks.filter(pa.array(hit))
                made = self._pieces(pc.utf8_slice_codeunits(words, 1) if skip else words, of)
                out[hit] = [self.newline + x for x in made] if skip else made
        at = np.flatnonzero(rest)
        if len(at):
            other = chunks.take(pa.array(at)).to_pylist()
            keep = [i for i, c in enumerate(other) if ALONE.fullmatch(c) and c != CUT]
            found = self._encode([c[1:] if c[0] == CUT else c if c[0] == "\n" else prefix + c for c in (other[i] for i in keep)])
            for i, x in zip(keep, found, strict=True):
                out[at[i]] = x
        return out.tolist()

    def _found(self, memory: dict[str, bytes], chunks: pa.Array, prefix: str) -> list[bytes | None]:
        """As ``_learn``, with a memory."""
        if len(memory) > REMEMBER:
            for c in list(islice(memory, REMEMBER // 2, None)):
                del memory[c]
        names = joined_by(chunks, " ").split(" ")
        found = list(map(memory.get, names))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            made = self._learn(chunks.take(pa.array(new)), prefix)
            for i, x in zip(new, made, strict=True):
                found[i] = x
            memory.update((c, x) for c, x in zip(map(names.__getitem__, new), made, strict=True) if x is not None and len(c) <= LONGEST)
        return found

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (little-endian unsigned 32-bit) of each text of a string column without nulls; '' has none."""
        if not len(texts):
            return []
        if not self.by_words:
            return [np.frombuffer(x, "<u4") for x in self._encode(texts.to_pylist())]
        holds = pc.match_substring(texts, CUT)  # what is used as a mark below
        spaced = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \n"), ENDED, f"\\1 {CUT}\\2")
        parts = pc.split_pattern(spaced, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        bounds, values = bounds - bounds[0], parts.flatten()
        coded = values.dictionary_encode()
        at = coded.indices.to_numpy().copy()
        heads = values.take(pa.array(bounds[:-1])).dictionary_encode()
        table = self._found(self.known, coded.dictionary, " ") + self._found(self.first, heads.dictionary, "")
        at[bounds[:-1]] = len(coded.dictionary) + heads.indices.to_numpy()
        del spaced, parts, values, coded
        bad = np.fromiter((x is None for x in table), bool, len(table))
        ids = pa.array([x or b"" for x in table] if bad.any() else table, pa.large_binary()).take(pa.array(at))
        _, offsets, data = ids.buffers()
        cuts = (np.frombuffer(offsets, np.int64, len(ids) + 1, ids.offset * 8) >> 2)[bounds]
        flat = np.frombuffer(data, "<u4") if data is not None and data.size else np.empty(0, "<u4")
        out = [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
        wrong = np.searchsorted(bounds, np.flatnonzero(bad[at]), side="right") - 1  # white space in runs or at an end
        wrong = np.union1d(wrong, np.flatnonzero(holds.to_numpy(zero_copy_only=False))).tolist()
        for i, x in zip(wrong, self._encode([texts[i].as_py() for i in wrong]), strict=True):  # the library sees the whole text
            out[i] = np.frombuffer(x, "<u4")
        return out


def slices(texts: pa.Array, limit: int = 8_000_000) -> Iterable[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes."""
    before = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]) if len(texts) else np.zeros(1)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(before, before[start] + limit)))
        yield start, min(end, len(texts))
        start = end


def encoder(definition: str) -> Encoder:
    """One encoder a worker process and definition."""
    if definition not in _ENCODERS:
        _ENCODERS[definition] = Encoder(definition)
    return _ENCODERS[definition]


def definition(path: str) -> str:
    """The tokenizer's JSON, read on the driver; a vocabulary is of bounded size, and that is checked."""
    with open(path, encoding="utf-8") as f:
        found = f.read()
    if len(found) > 64_000_000:
        raise ValueError(f"{path}: over 64 MB, not a vocabulary file")
    return found
