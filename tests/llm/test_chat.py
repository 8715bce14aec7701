import random

import duckdb

from veilwork.llm import chat
from veilwork.llm.queries import ORACLE_SQL, op8_chat

SF = "/root/testdata/sf0.001"


def brute(rows):
    sides = {}
    for pair, side, turn, role, text in rows:
        if pair is not None and turn is not None and side in ("chosen", "rejected"):
            own = sides.setdefault(pair, {"chosen": {}, "rejected": {}})[side]
            own[turn] = min(own.get(turn, ("￿",)), (role or "", text or ""))
    out = {}
    for pair, both in sides.items():
        turns = sorted(set(both["chosen"]) | set(both["rejected"]))
        first = next((t for t in turns if both["chosen"].get(t) != both["rejected"].get(t)), None)
        for t in turns:
            record = out.setdefault((pair, t // chat.RECORD_TURNS), {"prompt": "", "chosen": "", "rejected": "", "spans": {"prompt": [], "chosen": [], "rejected": []}})
            shared = first is None or t < first
            for part in ["prompt"] if shared else ["chosen", "rejected"]:
                said = both["chosen" if shared else part].get(t)
                if said:
                    text = said[1].replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")
                    record[part] += f"<|im_start|>{said[0]}\n"
                    start = len(record[part])
                    record[part] += f"{text}<|im_end|>\n"
                    if said[0] == "assistant":
                        record["spans"][part].append((start, len(record[part])))
    return sorted((*k, r["prompt"], r["chosen"], r["rejected"], r["spans"]["chosen"], r["spans"]["rejected"]) for k, r in out.items())


def plain(df):
    return sorted((*r[:5], [tuple(s) for s in r[5]], [tuple(s) for s in r[6]]) for r in df.collect())


def test_pairs_against_brute_force(spark):
    rnd = random.Random(6)
    rows = [(None, "chosen", 0, "user", "x"), (1, "other", 0, "user", "x"), (1, "chosen", None, "user", "x"), (50, "chosen", 0, None, None), (51, "rejected", 3, "assistant", "only <|im_end|> side")]
    for pair in range(40):
        for side in ("chosen", "rejected"):
            for turn in range(rnd.randint(0, 5)):
                rows.append((pair, side, turn, ["user", "assistant", None][turn % 2 if rnd.random() < 0.9 else 2], rnd.choice(["a", "a", "a", "b", "", None])))
                if rnd.random() < 0.1:
                    rows.append(rows[-1][:4] + ("again",))
    rows.append((60, "chosen", 0, "assistant", "long " * 20_000))
    for turn in range(-3, 900):
        # One pair of several records, whose prompt ends in the third.
        rows += [(61, "chosen", turn, ["user", "assistant"][turn % 2], f"t{turn}"), (61, "rejected", turn, ["user", "assistant"][turn % 2], f"t{turn}" if turn != 700 else "𝔘 other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "pair_id long, side string, turn int, role string, text string, segment int").repartition(4)
    out = chat.format_preferences(df)
    assert out.columns == ["pair_id", "record", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans"]
    assert plain(out) == brute(rows)
    assert chat.format_preferences(df.limit(0)).count() == 0


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = op8_chat(spark, SF)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['op8_chat']})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_query_rules_against_sql(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b. c"), (1, 1, "assistant", "B. d"), (1, 2, None, None), (2, 0, "assistant", None), (3, 0, "user", "<|im_end|>"), (None, 0, "user", "x"), (4, None, "user", "x")]
    rows += [(5, t, ["user", "assistant"][t % 2], f"first {t}. second") for t in range(600)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = op8_chat(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['op8_chat']})").fetchall()
    assert len(want) == 6
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
