"""Lines that are near to an earlier line of one word less than the floor."""

import random

from tidemark.llm import line_dedup as ld


def test_earlier_line_below_the_floor(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5)]
    lines = [[rng.choice(words) for _ in range(rng.randint(6, 9))] for _ in range(50)]
    rows = []
    for d in range(90):
        text = []
        for _ in range(3):
            line = list(rng.choice(lines))
            at, how = rng.randrange(len(line)), rng.random()
            line[at : at + (how < 0.5)] = [] if how < 0.3 else [rng.choice(words)]
            text.append(" ".join(line))
        rows.append((d, "\n".join(text)))
    rows += [(200, "a b c d e f g"), (201, "a b c d e f g h"), (202, "a b c d e f x"), (203, "k l m n o p q r"), (204, "k l m n o p q")]
    want, seen, short = {}, [], 0
    for d, text in rows:
        for i, line in enumerate(text.split("\n")):
            w = line.encode().split()
            if w in seen:
                want[d, i] = False
            else:
                near = len(w) >= 8 and any(ld.one_edit(w, o) for o in seen)
                short += near and not any(ld.one_edit(w, o) for o in seen if len(o) >= 8)
                seen.append(w)
                if near:
                    want[d, i] = True
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc"], r["line_no"]): r["near"] for r in ld.duplicate_lines(df).collect()}
    assert short > 1 and got == want and got[201, 0] and (202, 0) not in got and (204, 0) not in got
