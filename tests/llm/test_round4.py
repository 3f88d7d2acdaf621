"""What the driver holds in the Jaccard join."""

import re

import pytest

from .test_operators import llm, made  # noqa: F401

FIXED, COUNTED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture()
def plans(monkeypatch):
    """Plans of what the join writes, as made before any bytes are counted."""
    from waymark.llm import graph, jaccard_groups
    found, write = [], jaccard_groups.materialize

    def record(df):
        found.append(planned(df))
        return write(df)

    monkeypatch.setattr(jaccard_groups, "materialize", record)
    monkeypatch.setattr(graph, "materialize", record)
    return found


def near_copies():
    """Texts of which many are near copies of one, and the usual ones."""
    words = [f"w{i}" for i in range(200)]
    many = [(1000 + i, " ".join([*words[:i], f"x{i}", *words[i + 1:]])) for i in range(0, 200, 4)]
    return made(5, 40) + many


def test_jaccard_sends_only_keys_before_bytes_are_counted(llm, plans):  # noqa: F811
    from waymark.llm.jaccard_groups import keep_one_of_group
    docs = llm.createDataFrame(near_copies(), "doc_id long, text string")
    kept = keep_one_of_group(llm, docs, "")
    sent = [p for p in [*plans, planned(kept)] if "BroadcastHashJoin" in p]
    assert len(plans) > 20 and len(sent) == 1
    assert len(re.findall("BroadcastHashJoin", sent[0])) == 1 and re.search(r"BroadcastHashJoin \[__key#\d+L\], \[__key#\d+L\], LeftSemi", sent[0])
    assert "BroadcastHashJoin" not in planned(kept) and kept.count() < docs.count()


def test_jaccard_differences_do_not_stand_beside_their_tokens(llm, plans):  # noqa: F811
    from waymark.llm.jaccard_groups import near_duplicates
    near_duplicates(llm.createDataFrame(near_copies(), "doc_id long, text string")).count()
    spread = [x for p in plans for x in re.findall(r"Generate explode\(slice\(tokens#\d+, 1, keep#\d+\)\), \[([^\]]*)\]", p)]
    assert spread and not any("tokens" in x for x in spread)


@pytest.mark.parametrize("fixed, counted, within", [("10m", None, 1 << 20), ("256k", None, 256 << 10), ("100", None, 100), ("5GB", "64KB", 64 << 10), ("-1", None, -1), ("10485760b", "-1", -1)])
def test_counted_broadcasts_leaves_the_session_as_it_was(llm, fixed, counted, within):  # noqa: F811
    from waymark.llm.common import counted_broadcasts
    seen = lambda: [llm.conf.get(k, None) for k in (FIXED, COUNTED)]
    first = seen()
    try:
        llm.conf.set(FIXED, fixed)
        llm.conf.unset(COUNTED) if counted is None else llm.conf.set(COUNTED, counted)
        before, inner = seen(), counted_broadcasts(lambda df: seen())
        assert inner(llm.range(1)) == ["-1", str(within)] == counted_broadcasts(lambda df: inner(df=df))(llm.range(1))
        with pytest.raises(ZeroDivisionError):
            counted_broadcasts(lambda df: 1 / 0)(llm.range(1))
        assert seen() == before
    finally:
        for k, v in zip((FIXED, COUNTED), first):
            llm.conf.unset(k) if v is None else llm.conf.set(k, v)
