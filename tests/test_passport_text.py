"""Passport lines in masked text."""

from veilwork.functions import text as X


def test_passport_lines_are_hidden_whole(spark):
    one, two = "P<INDKUMAR<<ANAND" + "<" * 27, "L8988901<1IND8308081M2601011" + "<" * 14 + "02"
    texts = [f"a\n{one}\n{two}\nb", f"{one.lower()[:9]} {one[9:]}\n \n{two}", f"{two}\n{one}", f"{one}\nbetween\n{two}", one, f"{one}\n{two.replace('IND', 'USA')}"]
    got = {r.text: (r.masked, r.n_masked) for r in X.mask_text(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got[texts[0]] == (f"a\n{'X' * 44}\n{'X' * 44}\nb", 1)
    assert got[texts[1]] == (f"{'X' * 45}\n \n{'X' * 44}", 1)
    assert all(got[t] == (t, 0) for t in texts[2:])
