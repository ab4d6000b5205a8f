import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=0, n=60):
    """Rows with nulls, empty and blank texts, long repeats, copies, near copies and repeated rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgäéñ", k=r.randint(2, 8))) for _ in range(200)] + ["The", "OF", "don't", "x1,", "—"]
    prose = lambda k: " ".join(r.choices(vocab, k=k))
    passage, other = prose(90), prose(40)
    texts = [prose(r.randint(1, 150)) for _ in range(n)]
    for i in range(0, n, 4):
        texts[i] = prose(r.randint(0, 30)) + " " + passage + ("\n" if i % 8 else " ") + prose(r.randint(0, 30))
    for i in range(1, n, 7):
        texts[i] = prose(3) + other + other + prose(5)
    base = prose(300)
    for i in range(2, n, 9):
        words = base.split()
        words[r.randrange(300)] = "changed"
        texts[i] = " ".join(words)
    texts[3] = texts[7] = texts[11] = prose(120)
    texts += [None, "", "   \n\t ", "a" * 3000, "ab " * 900, "\n".join(["same line here"] * 40), prose(4000), "é" * 700, "word\x0bwith\x0codd\x1cspace\x85here x"]
    rows = [(i, t, "en", None if i % 11 == 5 else f"s{i % 5}" if i % 13 else "", None) for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None), (None, None, None, "s1", 1), rows[4], rows[4], (9, prose(30), "en", "é", 2)]
    return rows
