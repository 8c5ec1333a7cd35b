"""Texts that are hard for tokenizers."""


def edge_texts() -> list[str]:
    return [
        " ", "\n", "\n\n  x", "a  b\n\n c\t\td ", "  lead", "trail  ", "It's WE'LL don't'", "x², ½!! (((a))) ...b", "<|endoftext|>",
        "<s> </s> <unk> <0x41>", "a▁b ▁ ▁▁c", "▁", "é é Å ﬁ İstanbul ΣΑΣ", "漢字かな 😀😀 a" * 3, "w" * 200 + ", " + "v" * 60 + "!", "tab\t",
        "a \r\n b", "nul\x00nul", " nb em​zero", " private \U0010ffff", "é combined",
    ]
