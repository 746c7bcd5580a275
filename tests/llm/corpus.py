"""A small corpus with what the operators have to bear: nulls, empty and long texts, copies, repeated rows, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, ord long, block long, start long"


def words(r, n, letters="abcdefghij"):
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(n)]


def texts(seed=1, n=60):
    r = random.Random(seed)
    vocab = words(r, 300)
    out = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(0, 160))]
        if i % 5 == 4:
            w = list(out[i - 2].split())
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = "changed"
        out.append("".join(x + r.choice([" ", " ", " ", "\n", "\t ", ", "]) for x in w))
    return out


def rows(seed=1, n=60):
    t = texts(seed, n)
    t[3], t[4], t[5], t[6] = None, "", " \n\t ", "one"
    t[7] = "Été Ünïcode ẞ İstanbul ﬁ \u00a0 \u2028 x\u0301 " * 9
    t[8] = " ".join(words(random.Random(5), 9000))
    t[9] = t[10]
    t[11] = "same words again " * 60
    out = [(i * 3, x, "en" if i % 2 else "de", f"s{i % 3}", len(x or ""), i, 7, 1, 2) for i, x in enumerate(t)]
    return out


def odd_rows():
    """Also null ids and repeated rows."""
    base = rows()
    return base + [base[12], base[12], (None, base[13][1], None, None, None, None, None, None, None), (None, None) + (None,) * 7, (base[14][0], "another text with the same id") + base[14][2:]]
