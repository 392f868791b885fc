import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from sedimenta.operators import bytestats
from sedimenta.operators.rowwise import SLICE_BYTES, SLICE_ROWS, made_of, slices
from sedimenta.plans import reports


def test_slices_hold_every_value_once():
    values = [b"x" * n for n in (3, SLICE_BYTES, 1, 3 * SLICE_BYTES, 0)] + [None] * 2 + [b"y"] * (3 * SLICE_ROWS)
    some = list(slices(pa.array(values, pa.binary())))
    assert [x for s in some for x in s] == values
    assert max(map(len, some)) == SLICE_ROWS and all(len(s) == 1 or sum(len(x or b"") for x in s) <= SLICE_BYTES for s in some)
    assert list(slices(pa.array([], pa.binary()))) == [[]]


def test_profile_summary_makes_no_window_objects():
    """A payload of 40,000 windows takes less than its windows as dicts would, with the same sums."""
    raw = bytes(range(256)) * 1250
    windows = bytestats.windows_of(raw)
    tracemalloc.start()
    made = bytestats.summary_of(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made[9:12] == (len(windows), sum(w["is_spike"] for w in windows), sum(round(w["entropy"] * 1000) for w in windows))
    assert peak < 8_000_000


def test_profile_on_odd_rows(spark):
    """Texts that repeat, nulls and empty ones: the flat report agrees with the nested one, row for row."""
    texts = ["", "a", "abcdefgh", "z" * 31, "z" * 32, "é\U0001f600" * 900, None] + ["again"] * 40 + [f"row {k} " * (k % 50) for k in range(3000)]
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "source string, payload_id long, payload string").coalesce(1)
    got = {r.payload_id: r for r in reports.entropy_profile(df).collect()}
    assert sorted(got) == [k for k, t in enumerate(texts) if t is not None]
    for r in bytestats.entropy_profile(df).collect():
        if r.total_bytes is None:
            continue
        w, flat = r.sliding_window_profile, got[r.payload_id]
        assert (flat.total_bytes, flat.shannon_entropy, flat.classification, flat.special_pct) == (r.total_bytes, r.shannon_entropy, r.classification, r.char_classes.special_pct)
        assert (flat.windows, flat.spikes, flat.window_milli) == (len(w), sum(x.is_spike for x in w), sum(round(x.entropy * 1000) for x in w))
        assert flat.byte_distribution == ",".join(map(str, r.byte_distribution_256)) and flat.byte_frequencies == ",".join(f"{x.rank}:{x.b}:{x.n}" for x in r.byte_frequencies)


def test_repeated_texts_are_made_once(spark):
    made = made_of(F.col("t"), "n long, x double", lambda t: (len(t), __import__("random").random()))
    rows = spark.createDataFrame([(t,) for t in ["ab"] * 500 + [None] + ["c"]], "t string").coalesce(1).select("t", made.alias("m")).select("t", "m.*").collect()
    assert len({r.x for r in rows if r.t == "ab"}) == 1 and {(r.t, r.n) for r in rows} == {("ab", 2), (None, None), ("c", 1)}
