"""Token ids of whole texts by the tokenizers library, with a bounded memory of words seen."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

# The white space of Unicode, as a class of a regular expression.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words that one Python worker remembers, some 270 bytes each; further ones are encoded each time they come. Where other
#: stages need the memory too, so many. Bytes of text at once.
MOST_KNOWN, FEW_KNOWN, AT_ONCE = 1_000_000, 150_000, 2_000_000
#: Letters that keep their bytes under NFC; a word of these is one piece to the BPE model.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Marks a text's first word, which has no space before it.
FIRST = "\x01"
#: White space and control characters at which a cut at single spaces or ASCII white space would go wrong.
_ODD = "[\\x00-\\x08\\x0e-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_ODD_SPACES = _ODD + "|[\\t\\x0b\\x0c\\r]|  |\\n\\n| \\n|\\n "


def _byte_names() -> dict[int, str]:
    """Byte-level vocabularies name a byte by its own character where that is printable Latin-1, else by
    the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_NAMES = _byte_names()
#: Each Latin-1 character to the names of its UTF-8 bytes.
_TO_NAMES = {c: "".join(_NAMES[b] for b in chr(c).encode()) for c in range(256)}


class Encoder:
    """Texts to the packed ids that Tokenizer.encode(text, add_special_tokens=False) gives.

    Both vocabularies cut texts where white space begins after other characters and merge nothing across
    such a cut, so a word with the white space before it is encoded by itself, once for all its
    occurrences that a worker remembers: Arrow cuts a chunk of texts and numbers its words, only different
    words are looked up. A Latin word goes straight to the library's BPE model; other new words are
    encoded in one call, set apart by a special token, at which the library cuts too. Texts with unusual
    white space are cut by a regular expression of the same rule.
    ``spaces`` tells whether white space makes tokens and capitals are kept."""

    def __init__(self, name: str, spaces: bool, dtype: str, special: str, most_known: int = MOST_KNOWN) -> None:
        self._tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        self._model = self._tokenizer.model
        self._model._resize_cache(0)  # words are remembered here
        self._dtype, self._special, self._special_id = np.dtype(dtype), special, self._tokenizer.token_to_id(special)
        self._spaces = spaces
        self._units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+" if spaces else f"[^{WHITE}]+").findall
        self._simple = re.compile(f"(\\n?)( ?[{LATIN}]+)([.,]?)" if spaces else f"()([{LATIN}]+)([.,]?)").fullmatch
        self._code = "I" if self._dtype.itemsize == 4 else "H"
        self._marks = {x: self._ids(x).tobytes() if x else b"" for x in ("", ".", ",", "\n")}
        self._known: dict[str, bytes] = {}
        self._most_known = most_known

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self._dtype)

    def _unit(self, key: str) -> str:
        if not self._spaces or key[:1] == "\n":
            return key
        return key[1:] if key[:1] == FIRST else " " + key

    def _learn(self, units: dict[str, str]) -> dict[str, bytes]:
        """Keys and their units to keys and ids."""
        got, other, marks, tokenize = {}, [], self._marks, self._model.tokenize
        for key, u in units.items():
            if m := self._simple(u):
                word = (m[2] if self._spaces else m[2].lower()).translate(_TO_NAMES)
                got[key] = marks[m[1]] + array(self._code, [t.id for t in tokenize(word)]).tobytes() + marks[m[3]]
            elif "<|" in u:  # may hold a special token's string, or a part of one
                got[key] = self._ids(u).tobytes()
            else:
                other.append(key)
        if other:
            ids = self._ids(self._special.join(units[k] for k in other))
            cuts = np.flatnonzero(ids == self._special_id)
            packed, width = ids.tobytes(), self._dtype.itemsize
            starts, ends = [0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(packed)]
            got.update((k, packed[a:b]) for k, a, b in zip(other, starts, ends, strict=True))
        return got

    def _look_up(self, keys: list[str]) -> list[bytes]:
        ids = list(map(self._known.get, keys))
        if None in ids:
            gaps = [i for i, x in enumerate(ids) if x is None]
            got = self._learn({keys[i]: self._unit(keys[i]) for i in gaps})
            for i in gaps:
                ids[i] = got[keys[i]]
            if len(self._known) < self._most_known:
                self._known |= got
        return ids

    def _odd(self, text: str) -> bytes:
        units = self._units(text)
        got = self._learn({u: u for u in units})
        return b"".join(map(got.__getitem__, units))

    def many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, null as empty; in memory in proportion to the texts given at once."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD_SPACES if self._spaces else _ODD)
        plain = texts.filter(pc.invert(odd))
        if self._spaces:
            marked = pc.replace_substring(pc.binary_join_element_wise(FIRST, plain, ""), "\n", " \n")
            lists = pc.split_pattern(marked, " ")
        else:
            lists = pc.ascii_split_whitespace(plain)
        words = lists.flatten().dictionary_encode()
        ids = pa.array(self._look_up(words.dictionary.to_pylist()), pa.binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset) if len(ids) else np.zeros(1, np.int32)
        packed = memoryview(ids.buffers()[2]) if len(ids) and ids.buffers()[2] else b""
        at = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist() if len(plain) else [0]
        found = iter([bytes(packed[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])
        if not pc.any(odd).as_py():
            return list(found)
        return [self._odd(texts[i].as_py()) if x else next(found) for i, x in enumerate(odd.to_pylist())]


@lru_cache(maxsize=4)
def encoder(name: str, spaces: bool, dtype: str, special: str = "<|endoftext|>", most_known: int = MOST_KNOWN) -> Encoder:
    return Encoder(name, spaces, dtype, special, most_known)
