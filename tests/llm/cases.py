"""Rows that every operator on documents must take: nulls in any column,
empty and very long texts, ties, repeated rows, columns with other
operators' names."""

import random

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda "
         "omicron sigma tau upsilon phi chi psi omega rho").split()


def words(seed, n):
    r = random.Random(seed)
    return [r.choice(WORDS) + str(r.randrange(40)) for _ in range(n)]


def text(seed, n):
    return " ".join(words(seed, n))


LONG = text(99, 60_000)
BASE = text(1, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
SCHEMA = ("doc_id long, text string, lang string, source string, "
          "n_chars long, id long, component_id string, size string, "
          "key string, a int, b int, n long, score string")


def rows():
    plain = [
        (1, BASE, "en", "s1"), (2, BASE, "en", "s2"), (3, NEAR, "en", None),
        (4, None, None, "s1"), (5, "", "en", "s1"), (6, " \n\t ", "en", "s3"),
        (7, "one", "en", "s3"), (8, "ONE", "en", "s3"), (9, LONG, "en", "s1"),
        (10, text(2, 80), "en", "s2"), (10, text(2, 80), "en", "s2"),
        (None, text(3, 50), "en", "s2"), (None, None, None, None),
        (11, "x" * 30_000, "en", "s4"), (12, "été   café", "fr", "s4")]
    return [(i, t, la, s, None, 7, "c", "s", "k", 1, 2, 3, "z")
            for i, t, la, s in plain]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return frame(spark, [])
