"""Token ids of whole texts, by a tokenizer file of the public library, inside Arrow batches.

A tokenizer whose pieces never cross ASCII white space is applied once per distinct
white-space separated word of a slice and the ids are gathered; texts that hold the
start of a special token, and all texts of other tokenizers, go through whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The normalizer and split of tokenizers that may be applied word by word.
_WORDWISE_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDWISE_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Marks of ASCII other than the apostrophe, and letters that NFC keeps and everyone lower-cases alike.
_MARKS, _LETTERS = r"!-&(-/:-@\[-`{-~", "A-Za-zÀ-ÖØ-öø-ÿ"
#: One piece of the split rule: letters, a digit or a run of marks.
_PIECE = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
#: Texts in which spaces around digits and marks change no piece.
_SPACEABLE = f"^[\\t-\\r -~{_LETTERS}]*$"
_CLINGING = f"'[{_MARKS}]|[{_MARKS}]'"

_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Encodes Arrow string arrays; words met before are remembered, at most ``remember`` of them."""

    def __init__(self, path: str, remember: int = 150_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path) as file:
            rules = json.load(file)
        normalizer, split = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
        steps = split.get("pretokenizers") or [{}]
        self.wordwise = (
            normalizer.get("normalizers") == _WORDWISE_NORMALIZER
            and steps[0].get("pattern") == {"Regex": _WORDWISE_SPLIT}
            and len(steps) == 2
            and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in rules["added_tokens"])
        )
        self.special = sorted({t["content"][:2] for t in rules["added_tokens"]})
        if self.wordwise:
            # the same merges for pieces that are normalized, split and spelled in byte signs already
            self.piece = Tokenizer(self.whole.model)
            self.piece.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.sign = {i: signs.pre_tokenize_str(chr(i))[0][0][-1] for i in range(0x80, 0x100)}
            self.sign |= {i: signs.pre_tokenize_str(chr(i + 0x40))[0][0][-1] for i in range(0x80, 0xC0)}
            self.sign |= {0xC2: signs.pre_tokenize_str(chr(0x80))[0][0][0], 0xC3: signs.pre_tokenize_str(chr(0xC0))[0][0][0]}
            vocab = self.whole.get_vocab()
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for token, i in vocab.items() if token.endswith(rules["model"]["end_of_word_suffix"])]] = True
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _store(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.slot)
        self.slot.update(zip(words, range(first, first + len(words))))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(words)] = lengths
        self.used += len(flat)

    def _learn(self, words: list[str]) -> None:
        """Give each new word a slot and its ids."""
        plain, odd = [], []
        for word in words:
            (plain if _PIECE.fullmatch(word) else odd).append(word)
        spelled = " ".join([w if w.isascii() else w.lower().encode().decode("latin-1").translate(self.sign) for w in plain])
        flat = np.array(self.piece.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[flat])
        if len(ends) == len(plain):
            self._store(plain, flat, np.diff(ends, prepend=-1))
        else:
            odd += plain
        ids = [e.ids for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._store(odd, np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths)

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slot) > self.remember:
            self._forget()
        texts = pc.ascii_lower(texts)
        spaceable = pc.and_not(pc.match_substring_regex(texts, _SPACEABLE), pc.match_substring_regex(texts, _CLINGING))
        spaced = pc.replace_substring_regex(texts, f"([0-9]|[{_MARKS}]+)", r" \1 ")
        lists = pc.ascii_split_whitespace(pc.if_else(spaceable, spaced, texts))
        edges = np.asarray(lists.offsets)
        coded = lists.values.slice(int(edges[0]), int(edges[-1] - edges[0])).dictionary_encode()
        names = coded.dictionary.to_pylist()
        slots = list(map(self.slot.get, names))
        if None in slots:
            self._learn([n for n, s in zip(names, slots) if s is None])
            slots = list(map(self.slot.get, names))
        slot = np.array(slots, np.int64)[np.asarray(coded.indices)]
        lengths = self.lengths[slot]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[slot] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.flat[at], ends[edges - edges[0]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one after another, and where each text begins and the last ends; null is empty."""
        # taken anew: some string functions of Arrow read past the beginning of a slice
        texts = texts.cast(pa.large_string()).fill_null("").take(pa.array(np.arange(len(texts))))
        odd = np.ones(len(texts), bool)
        if self.wordwise:
            odd[:] = False
            for mark in self.special:
                odd |= np.asarray(pc.match_substring(texts, mark).to_numpy(zero_copy_only=False), bool)
        if not odd.any():
            return self._by_word(texts) if len(texts) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        whole = iter(self.whole.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False))
        rest = texts.filter(pa.array(~odd))
        flat, edges = self._by_word(rest) if len(rest) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        parts, k = [], 0
        for strange in odd:
            if strange:
                parts.append(np.asarray(next(whole).ids, np.uint32))
            else:
                parts.append(flat[edges[k] : edges[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def encoder(path: str) -> Encoder:
    """The encoder of a file, one per Python worker; every machine has the file at ``path``."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def ended(flat: np.ndarray, edges: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each text."""
    return np.insert(flat, edges[1:], end_id), edges + np.arange(len(edges))
