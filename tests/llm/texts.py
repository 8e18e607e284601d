"""Texts that tokenizers and splitters get wrong first."""

import random

ALPHABET = ["a", "B", "é", "é", "ß", "ﬁ", "İ", "Σ", "ς", "1", "23", "'s", "'ll", "!", "...", "-", "_", "中", "文", "🙂", "👩‍👩‍👧", "‍",
            "▁", "▁▁", " ", "  ", "   ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "\x00",
            "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "word", "Licence", "http://x.y/z?q=1"]


def odd_texts(n: int, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    fixed = ["", " ", "  ", "   ", "\n", "a", " a", "a ", "a  ", "  a  b  ", "▁", "a▁", "a\n \n b", "x" * 3000, " " * 3000, "ab " * 5000, "é" * 500]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(n)]
