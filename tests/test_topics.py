"""Topics of sessions whose texts are long."""

import pytest

from skeinlake import plans


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Eight conversations that are one session of 12 units, and 11 more such, all with what counts behind 4,000 characters.

    Beginnings have words of their own in each unit; what follows in the first session is of one topic, and short answers come after long ones.
    """
    rows = []
    for session in range(12):
        for u in range(12):
            own = " ".join(f"head{session}x{u}n{i}" for i in range(10)) + " ." * 2500
            topic = " ".join(f"topic{session}n{i} topic{session}n{i}" for i in range(60))
            at = (session * 8 + u * 8 // 12, u * 4)
            rows += [(*at, "user", f"{own} {topic} asked{session} asked{session}")]
            rows += [(at[0], at[1] + 1, "assistant", f"{own} {topic}"), (at[0], at[1] + 2, "assistant", " ." * 2500), (at[0], at[1] + 3, "assistant", f"last{session} " * 9)]
    path = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


def test_keywords_come_from_whole_texts(spark, long_texts):
    found = {(r.session_id, r["rank"]): r.word for r in plans.queries()["episode_keywords"](spark, long_texts).collect() if r.episode == 0}
    assert [found[s, 1] for s in range(12)] == [f"last{s}" for s in range(12)]
    assert [found[s, 2] for s in range(12)] == [f"topic{s}n0" for s in range(12)]


def test_segments_come_from_whole_texts(spark, long_texts):
    """Beginnings share no word, so a pause of an hour would cut; what follows is of one topic, so nothing is cut."""
    found = plans.queries()["greedy_segments"](spark, long_texts).collect()
    assert sorted((r.session_id, r.first_unit, r.last_unit) for r in found) == [(s, 0, 11) for s in range(12)]
