import re

from tabloom.llm.line_rules import clean_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(i, t):
    t = t or ""
    words = WORD.findall(t)
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k:k + 8]), []).append(k)
    covered = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed)


PROSE = " ".join(f"word{k}" for k in range(30)) + "."
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, PROSE), (5, PROSE + "\n" + PROSE), (6, "a b c d e f g h a b c d e f g h i"),
        (7, "x " * 50), (8, "same\nsame\n same\nsame\n\n"), (9, "été 日本 🙂 # * <b> & | % $"), (10, ("w%d " * 3) * 9),
        (11, " ".join(f"v{k}" for k in range(60_000))), (12, (PROSE + " ") * 300), (None, PROSE), (4, PROSE),
        (13, "lead\x0bline\x0c two\r\n three"), (14, " ".join(f"w{k}" for k in range(27)) + " " + " ".join(f"w{k}" for k in range(8)))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as __text", "3 as kept")


def test_counts_equal_brute_force(spark):
    out = clean_lines(frame(spark, ROWS)).collect()
    got = sorted([tuple(r)[:7] for r in out], key=str)
    assert got == sorted([brute(*r) for r in ROWS], key=str)
    assert not any(r.kept and r.base_failed for r in out)


def test_line_verdicts(spark):
    menu = "Home | News | Sport | About | Contact"
    table = " | ".join(f"cell{k}" for k in range(40))
    symbols = " ".join(f"w{k}***" for k in range(40)) + "."
    rows = [(1, PROSE + "\n" + menu + "\nAll rights reserved."), (2, PROSE + "\n" + table + "\n" + table), (3, symbols),
            (4, " ".join(f"w{k}" for k in range(40))), (5, PROSE)]
    out = {r.doc_id: r for r in clean_lines(frame(spark, rows)).collect()}
    assert out[1].kept and out[1].clean_text == PROSE and out[1].n_lines_removed == 2
    assert not out[2].kept and not out[3].kept and not out[4].kept
    assert out[5].kept and out[5].n_lines_removed == 0


def test_plan_is_native(spark):
    plan = clean_lines(frame(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert clean_lines(frame(spark, [])).count() == 0
