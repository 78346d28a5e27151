import random
import re
from collections import Counter

from quadrille.llm.quotes import SLICE, link_quotes

MARK = re.compile(r"^(\s*>)+ ?")
norm = lambda t: re.sub(r"\s+", " ", t).strip().lower()


def fives(text):
    w = norm(text).split(" ")
    return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}


def linked(passage, said):
    """The turn that most parts of a passage name, if they are half of them or more."""
    w = passage.split(" ")
    parts = [" ".join(w[k : k + 5]) for k in dict.fromkeys([*range(0, len(w) - 4, 5), len(w) - 5])] if len(w) >= 5 else [passage]
    named = Counter(max((t for t, keys in said if p in keys), default=None) for p in parts)
    votes, turn = max(((n, t) for t, n in named.items() if t is not None), default=(0, None))
    return turn if 2 * votes >= len(parts) else None


def brute(rows):
    """(conv, turn, role, text), turns distinct -> the operator's rows."""
    out = []
    for conv in {r[0] for r in rows}:
        said, prior, branch, place = [], None, None, 0
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            lines = []
            for x in (text or "").split("\n"):
                m = MARK.match(x)
                lines.append((m.group(0).count(">") if m else 0, MARK.sub("", x)))
            runs = []
            for level, x in lines:
                if runs and runs[-1][0] == level:
                    runs[-1][1] += "\n" + x
                else:
                    runs.append([level, x])
            quotes = [(level, norm(x)) for level, x in runs if level and norm(x)]
            found = [(-level, linked(q, said)) for level, q in quotes]
            found = [f for f in found if f[1] is not None]
            body = "\n".join(x for level, x in lines if not level).strip(" ")
            said.append((turn, {norm(x) for x in [body, *re.split(r"\n\s*\n", body), *body.split("\n")]} - {""} | fives(body)))
            parent = max(found)[1] if found else prior
            if prior is None or parent != prior:
                branch, place = turn, 0
            else:
                place += 1
            out.append((conv, turn, role, parent, branch, place, len(quotes), len(found), body, f"<|{role}|>\n{body}\n"))
            prior = turn
    return out


def test_threads_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(rng.randrange(1, 12)):
            own = "\n".join(" ".join(rng.choice("alpha beta Gamma delta epsilon zeta".split()) for _ in range(rng.randrange(1, 16))) for _ in range(rng.randrange(1, 4)))
            quote = ""
            for _ in range(rng.randrange(3)):
                if texts:
                    x, level = rng.choice(texts), rng.randrange(1, 4)
                    quote += "\n".join((">" * level if rng.random() < 0.5 else "> " * level) + " " + y.upper() for y in x.split("\n")) + "\n"
            texts.append(own)
            rows.append((conv, turn * rng.randrange(1, 3) + turn * SLICE * (conv % 2), rng.choice(["user", "assistant"]), quote + own))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    got = [tuple(r) for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    key = lambda r: r[:2]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert any(r[7] for r in got) and any(r[4] != min(x[1] for x in rows if x[0] == r[0]) for r in got)


def test_trimmed_and_rewrapped_quotes(spark):
    first = "The first paragraph has several words in it.\n\nA second one follows, which is rather longer than that\nand goes over two lines.\n\nThe third closes it. It says no more."
    other = "Something else that nobody quotes, of about as many words."
    quotes = {
        "two of three paragraphs": "> The first paragraph has several words in it.\n>\n> A second one follows, which is rather longer than that\n> and goes over two lines.",
        "a part of a paragraph, wrapped anew": "> which is rather\n> longer than that and\n> goes over two",
        "a sentence of a line": "> The third closes it. It says",
        "with words left out": "> A second one follows, which is rather longer [...] and goes over two lines.",
        "nested": ">> The first paragraph has several words in it.",
    }
    rows = [(c, t, "user", x) for c, q in enumerate(quotes.values()) for t, x in enumerate([first, other, q + "\nmy answer"])]
    got = link_quotes(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).where("turn = 2").collect()
    assert len(got) == len(quotes) and all(r.parent_turn == 0 and r.n_linked == 1 and r.message == "my answer" for r in got)


def test_odd_rows(spark):
    rows = [(None, None, None, None, 1), (None, 1, "user", "> x\n\ny", 2), (1, 1, "user", "hi", 3), (1, 1, "user", "hi", 3), (1, 2, "user", ">>> hi\n> \n>", 4), (2, None, "user", "hi", 5), (2, 3, "user", "> hi", 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = link_quotes(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn, r.message): r for r in got}
    assert by[1, 2, ""].n_linked == 1 and by[1, 2, ""].parent_turn == 1
    assert by[2, 3, ""].n_quotes == 1 and by[2, 3, ""].n_linked == 0
    assert link_quotes(df.limit(0)).count() == 0


def test_one_long_conversation(spark):
    rows = [(1, t, "user", f"m{t}" if t % 100 else f"> m{t // 2 - 1}\nm{t}") for t in range(3000)]
    got = [tuple(r) for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_sql_says_the_same_of_quoted_conversations(spark, tmp_path):
    import duckdb

    from quadrille.llm.queries import ORACLES

    rng = random.Random(11)
    rows = []
    for conv in range(8):
        texts = []
        for turn in range(9):
            quote = "".join(f"{'>' * rng.randrange(1, 3)} {rng.choice(texts)}\n" for _ in range(rng.randrange(3))) if texts else ""
            texts.append(" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(1, 19))))
            rows.append((conv, turn, "user", quote + texts[-1]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations/*.parquet')")
    want = duck.sql(ORACLES["op3_quotation_linking"]).df()
    got = link_quotes(df).fillna(-1, ["parent_turn"]).toPandas()
    both = [sorted(map(str, x[sorted(want.columns)].astype(object).where(x[sorted(want.columns)].notna(), None).astype(str).values.tolist())) for x in (got, want)]
    assert [x.replace(".0'", "'") for x in both[0]] == [x.replace(".0'", "'") for x in both[1]]
