"""Small documents with nulls, empty, blank and long texts, ties, repeated rows and columns with clashing names."""

import random

FOLDER = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, bits long, n_lines int, toxicity double, "
    "uid long, id string, `a.b` string"
)
WORDS = "the of and to in is that it for on was with as by at from are this be or an trash idiot model data copy".split()


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())


def words_of(text):
    return lower(text).split()


def edge_texts(seed=5, n=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed"]) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
        rows.append((i, "\n".join(lines)))
    for i in range(0, n, 4):  # near copies: one word of each line changed, added or left out
        lines = []
        for line in rows[i][1].split("\n"):
            parts, at = line.split(" "), rng.randrange(len(line.split(" ")))
            parts[at : at + rng.randint(0, 1)] = rng.choice([["XYZ"], [], ["Idiot", "two"]])
            lines.append(" ".join(parts))
        rows.append((100 + i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, " \t\n\n "), (203, rows[3][1].upper()), (204, rows[3][1]), (None, rows[3][1]), (None, None)]
    rows += [(205, " ".join(rng.choice(WORDS) for _ in range(30_000)) + "x" * 5000), (3, rows[3][1]), (3, rows[3][1]), (7, rows[8][1])]
    rows += [(206, "One line.\n\nOne line.\nOne  LINE."), (207, "漢字 かな　x  two  spaces   end "), (208, "é" * 300 + " zz")]
    return rows


def edge_docs(spark, rows=None):
    rows = edge_texts() if rows is None else rows
    full = [(d, t, "en", f"src{k % 3}", None if t is None else len(t), k, 1, 0.5, k % 2, "x", "y") for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


class Union:
    """Disjoint sets of numbers."""

    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
