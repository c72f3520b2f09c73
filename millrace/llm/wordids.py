"""Token ids of texts by a ``tokenizers`` file, with the ids of words remembered.

The vocabulary's pre-tokenizer ends a token at every white space, and its other
steps look at no more than one run of letters, one digit or one run of other signs.
So a text's ids are those of its parts between spaces and line ends, one after
another, and a part's are those of its runs. Runs are encoded by the library; a run is
a part as well, so one memory holds both, and a word met as a part costs nothing more as
a run of another, such as with a comma. A part with characters for which that does not hold surely (anything
beyond Latin letters, or a special token's mark) is encoded by the library whole.
``tests/llm`` compares the result with the library's on whole texts.
"""

from __future__ import annotations

from array import array

from .common import worker_cache

REMEMBERED = 700_000   # entries of a generation, about 0.25 KB each
LONGEST = 64           # longer parts are not remembered

# Fixed value: the split pattern of the vocabulary file.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"   # the same on lower-case ASCII, with ``re``


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: the visible Latin-1
    characters for themselves, all others numbered from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory(dict):
    """Results of a function by text, made when first asked for. A full memory becomes
    the older generation, and what is asked for again moves back from it."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.pop(text, None)
        if found is None:
            found = self.make(text)
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class WordIds:
    def __init__(self, vocabulary: str):
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.pieces = self.tokenizer.model.tokenize
        self.alphabet = byte_alphabet()
        self.split, self.split_ascii = regex.compile(RUNS).findall, re.compile(ASCII_RUNS).findall
        self.plain = regex.compile(r"[!-~¡-įı-ɏ]+").fullmatch
        self.parts = Memory(self._part)

    @classmethod
    def of(cls, vocabulary: str) -> WordIds:
        return worker_cache(f"words {vocabulary}", lambda: cls(vocabulary))

    def __call__(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers, little end first."""
        return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").split(" ")))

    def _part(self, part: str) -> bytes:
        if part.isascii():
            if part.isalpha():
                runs = [part.lower()]
            elif part.isprintable() and "<|" not in part:
                runs = self.split_ascii(part.lower())
            else:
                return self._whole(part)
        elif "<|" in part or not self.plain(part):
            return self._whole(part)
        else:
            runs = self.split(part.lower())
        if len(runs) == 1 and runs[0] == part:
            return self._run(part)
        return b"".join(map(self.parts.__getitem__, runs))

    def _whole(self, part: str) -> bytes:
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [p.id for p in self.pieces(run)]).tobytes()
