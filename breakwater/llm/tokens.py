"""Token ids of whole texts, as bytes of little-endian unsigned 32-bit numbers."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

# White space as the tokenizers' own pattern sees it (Unicode White_Space), and that pattern: fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

MARKS = ".,;:!?#$%&*"


class Encoder:
    """A byte-level BPE with the 50k vocabulary's word pattern.

    The pattern never joins a character to white space that follows it, so a text may be cut before a blank that stands between two
    characters other than white space. These pieces recur, and so do the pattern's words in them; both are remembered, the first `kept`
    of each. Only new words reach the tokenizer's model. A text in which a blank stands elsewhere is encoded whole. A string of an added token
    is that token's id, as the library has it, and parts the text: what stands before and after it is encoded on its own.
    """

    def __init__(self, path: str, kept: int = 200_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is its share; set before the library starts threads
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: n for n, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {content: array("I", [n]).tobytes() for content, n in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        self.split = regex.compile(PATTERN).findall
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves, by the format
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}
        self.kept = kept
        self.words: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            letters = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
            if len(self.words) < self.kept:
                self.words[word] = found
        return found

    def _after_blank(self, piece: str) -> bytes:
        """The ids of a blank and a piece without blanks: letters and a tail of marks are two of the pattern's words."""
        bare = piece.rstrip(MARKS)
        if bare.isalpha():
            found = self._word(" " + bare)
            if len(bare) < len(piece):
                found += self._word(piece[len(bare) :])
        else:
            found = self.whole(" " + piece)
        if len(self.after_blank) < self.kept:
            self.after_blank[piece] = found
        return found

    def whole(self, text: str) -> bytes:
        return b"".join(map(self._word, self.split(text)))

    def ids(self, text: str | None) -> bytes:
        """The ids of a text, without an end; null counts as empty."""
        if not text:
            return b""
        if any(content in text for content in self.added):
            return b"".join(self.added[part] if part in self.added else self._plain(part) for part in self.cut(text) if part)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        head, *pieces = text.split(" ")
        if not head or head[-1] in SPACE:
            return self.whole(text)
        get = self.after_blank.get
        found = [self.whole(head)]
        for p in pieces:
            ids = get(p)
            if ids is None:
                if not p or p[0] in SPACE or p[-1] in SPACE:
                    return self.whole(text)
                ids = self._after_blank(p)
            found.append(ids)
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
