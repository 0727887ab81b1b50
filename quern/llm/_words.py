"""Token ids of texts from the ids of their words, remembered per Python worker."""

from __future__ import annotations

import base64
import functools
import json

import numpy as np

#: Words whose ids a Python worker remembers, and their characters in all; then the memory starts anew. With the ids of two
#: vocabularies, half as many.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 1 << 25
#: Longer words are not remembered: their texts are encoded whole.
LONGEST_WORD = 512


class WordIds(dict):
    """Ids of words as little-endian unsigned 16-bit bytes; texts are the joined ids of their words.

    A subclass says how a text is split so that no token spans two words, how new words are encoded together, and how a
    text is encoded whole, which happens if one of its words can't be encoded alone.
    """

    #: Words that can't be encoded alone, and characters that no such word has.
    odd_words: frozenset[str] = frozenset()
    odd_chars: frozenset[str] = frozenset()
    most_words, most_chars = CACHE_WORDS, CACHE_CHARS

    def __init__(self) -> None:
        super().__init__()
        self.chars = 0

    def split(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode(self, words: list[str]) -> list[bytes | None]:
        """Ids of each word; None for one that can't be encoded alone after all."""
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        split, near, odd = self.looked_up(texts)
        return [
            self.whole(text) if odd and not odd.isdisjoint(words) else b"".join(map(near.__getitem__, words))
            for text, words in zip(texts, split, strict=True)
        ]

    def looked_up(self, texts: list[str]) -> tuple[list[list[str]], dict[str, bytes], set[str]]:
        """The words of each text, the ids of all of them, and those that can't be encoded alone."""
        if len(self) > self.most_words or self.chars > self.most_chars:
            self.clear()
            self.chars = 0
        split = [self.split(t) for t in texts]
        distinct = {w for words in split for w in words}
        # A mapping of the batch's words alone: the whole one is too large for the processor's cache.
        near = dict(zip(distinct, map(self.get, distinct), strict=True))
        odd = self._learn(near, [w for w, ids in near.items() if ids is None])
        return split, near, odd

    def _learn(self, near: dict[str, bytes | None], new: list[str]) -> set[str]:
        """Remember the new words, here and in ``near``; return those that can't be encoded alone."""
        odd = {w for w in new if len(w) > LONGEST_WORD or w in self.odd_words}
        if not self.odd_chars.isdisjoint("".join(new)):
            odd |= {w for w in new if not self.odd_chars.isdisjoint(w)}
        plain = [w for w in new if w not in odd] if odd else new
        if plain:
            found = dict(zip(plain, self.encode(plain), strict=True))
            odd |= {w for w, ids in found.items() if ids is None}
            for w in odd & found.keys():
                del found[w]
            near |= found
            self |= found
            self.chars += sum(map(len, found))
        return odd


def _cut(ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The ids from each start to the next, as bytes."""
    raw, at = ids.tobytes(), (2 * starts).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:] + [len(raw)] * bool(at), strict=True)]


class LowerWords(WordIds):
    """For a vocabulary with word ends that drops white space: words between spaces and line ends are encoded alone.

    Words of Latin letters are lowered and cut here and merged by the fast library, which sees a word's end as a byte of its
    own that merges before all else. Words with other characters go through the tokenizer itself, told apart by a special
    token.
    """

    END = "\x01"
    most_words, most_chars = CACHE_WORDS // 2, CACHE_CHARS // 2
    #: Characters below this are as they are under normal form C; one of them becomes two in lower case.
    LATIN, TWO = "\u0250", "\u0130"

    def __init__(self, name: str):
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.special[-1]
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        pattern = rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(f"\n|{pattern}")
        suffix, byte_of = rules["model"]["end_of_word_suffix"], _byte_letters()
        ranks = {}
        for token, i in rules["model"]["vocab"].items():
            bare = token.removesuffix(suffix)
            ranks[bytes(byte_of[c] for c in bare) + (self.END.encode() if bare != token else b"")] = i
        self.ranked = tiktoken.Encoding("parts", pat_str=f"[^{self.END}]+{self.END}", mergeable_ranks=ranks, special_tokens={})
        self.line_end = ranks[f"\n{self.END}".encode()]

    def split(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def encode(self, words: list[str]) -> list[bytes]:
        if max(text := "\n" + "\n".join(words)) < self.LATIN and self.END not in text and self.TWO not in text and not any(t in text for t in self.special):
            parts = self.END.join(self.parts.findall(text.lower())) + self.END
            ids = np.array(self.ranked.encode_ordinary(parts), "<u2")
            return [x[2:] for x in _cut(ids, np.flatnonzero(ids == self.line_end))]
        other = [w for w in words if w and (max(w) >= self.LATIN or self.END in w or self.TWO in w or any(t in w for t in self.special))]
        known = dict(zip(other, self._slowly(other), strict=True))
        latin = [w for w in words if w not in known]
        if latin:
            known |= zip(latin, self.encode(latin), strict=True)
        return [known[w] for w in words]

    def _slowly(self, words: list[str]) -> list[bytes | None]:
        """The same by the tokenizer; words that hold the mark itself are left to whole texts."""
        plain = [w for w in words if not any(t in w for t in self.special)]
        text = "".join([self.mark + w for w in plain])
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2")
        known = dict(zip(plain, [x[2:] for x in _cut(ids, np.flatnonzero(ids == self.mark_id))], strict=True))
        return [known.get(w) for w in words]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: visible ones stand for themselves, others follow from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Spaced(WordIds):
    """Words that follow a space, or a line end if the key begins with one; the text itself follows a space."""

    odd_words = frozenset(["", "\n"])
    token_bytes: list[bytes]
    odd_chars = frozenset([c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["▁"])

    def split(self, text: str) -> list[str]:
        return text.replace("\n", " \n").split(" ")

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


class BytePairs(_Spaced):
    """Byte-level ids of a space and the text; strings of special tokens are plain text."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_end = ranks[b"\n"]
        self.token_bytes = [b""] * (max(self.tokenizer.get_vocab_size(), max(ranks.values()) + 1))
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.token_bytes[i] = token.content.encode()

    def encode(self, words: list[str]) -> list[bytes]:
        text = "".join([w if w[0] == "\n" else f"\n {w}" for w in words])
        ids = np.array(self.ranked.encode_ordinary(text), "<u2")
        found = _cut(ids, np.flatnonzero(ids == self.line_end))
        return [x if w[0] == "\n" else x[2:] for w, x in zip(words, found, strict=True)]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(f" {text}", add_special_tokens=False).ids, "<u2").tobytes()


class Pieces(_Spaced):
    """Ids of a sentence-piece model that puts a space before the text and keeps bytes it has no piece for.

    A word is encoded alone only if its pieces give back its bytes.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token_bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.opens = np.array([p.startswith("▁") for p in pieces])
        self.space = int(self.model.piece_to_id("▁")).to_bytes(2, "little")

    def encode(self, words: list[str]) -> list[bytes | None]:
        ids = np.array(self.model.encode(text := " ".join(words), num_threads=1), "<u2")
        found = _cut(ids, np.flatnonzero(self.opens[ids]))
        if len(found) == len(words) and self.joined(ids) == f" {text}".encode():
            # the space before a line end is only there to tell the words apart
            return [x if w[0] != "\n" else x[2:] if x[:2] == self.space else None for w, x in zip(words, found, strict=True)]
        return [None] if len(words) == 1 else [x for w in words for x in self.encode([w])]

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, num_threads=1), "<u2").tobytes()


class BothIds(_Spaced):
    """Ids of the same words under a byte-level and a sentence-piece vocabulary, remembered together."""

    most_words, most_chars = CACHE_WORDS // 2, CACHE_CHARS // 2

    def __init__(self, names: tuple[str, str]):
        super().__init__()
        self.a, self.b = BytePairs(names[0]), Pieces(names[1])

    def encode(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        pairs = zip(self.a.encode(words), self.b.encode(words), strict=True)
        return [None if y is None else (x, y) for x, y in pairs]

    def whole(self, text: str) -> tuple[bytes, bytes]:
        """Ids of the whole text, both empty unless the tokens of either give back the bytes of a space and the text."""
        x, y = self.a.whole(text), self.b.whole(text)
        raw = f" {text}".encode()
        if any(v.joined(np.frombuffer(ids, "<u2")) != raw for v, ids in ((self.a, x), (self.b, y))):
            return b"", b""
        return x, y

    def both(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        split, near, odd = self.looked_up(texts)
        near_a, near_b = ({w: ids[k] for w, ids in near.items() if ids is not None} for k in (0, 1))
        out_a, out_b = [], []
        for text, words in zip(texts, split, strict=True):
            if not text:
                x = y = b""
            elif odd and not odd.isdisjoint(words):
                x, y = self.whole(text)
            else:
                x, y = b"".join(map(near_a.__getitem__, words)), b"".join(map(near_b.__getitem__, words))
            out_a.append(x)
            out_b.append(y)
        return out_a, out_b


@functools.cache
def words_of(kind: type[WordIds], name: str | tuple[str, str]) -> WordIds:
    """One for all tasks of a Python worker."""
    return kind(name)
