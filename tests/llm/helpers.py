"""A small corpus with every awkward case, and rows as tuples."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed=1, n=60):
    """(doc_id, text) rows with copies, near copies, shared lines, long and odd texts, nulls and repeated rows."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["é%dà" % i for i in range(60)] + ["Aa", "the", "of", "#", "|"]
    line = " ".join(rng.choices(vocab, k=9))
    passage = " ".join(rng.choices(vocab, k=40))
    out = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.choice([0, 1, 3, 7, 30, 80, 200]))
        text = " ".join(words)
        if i % 4 == 0:
            text += "\n" + line + rng.choice(["", " ", "\t"])
        if i % 5 == 0:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        out.append((i, text))
    for i in range(n, n + 15):  # copies, some with a few words changed
        words = out[rng.randrange(n)][1].split(" ")
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append((i, " ".join(words)))
    big = " ".join(rng.choices(vocab, k=4000))
    return out + [(200, big), (201, big[:-9] + " x"), (202, None), (203, ""), (204, " \n\t"), (205, "ab ab ab ab ab ab ab ab"), (206, "same"), (206, "same"), (None, "no id here at all, really none"), (-5, passage)]


def collected(df):
    """Rows as sorted tuples; bytes are plain, nulls come first."""
    out = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()]
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])
