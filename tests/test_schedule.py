"""Team and merged schedule views on a small own season."""

from pyspark.sql import functions as F

from pressroll.operators import schedule as Sc

DDL = ("team string, pos long, phase string, week int, opponent string, home boolean, dateKST string, "
       "etLabel string, bcast string, final struct<ko:string,en:string>, rivalry boolean, bye boolean, tbd boolean")


def season(spark):
    rows = [
        ("GB", 0, "pre", 2, "Herons", True, "2031-08-21T11:10:00+09:00", "8/20 (Wed) 10:10 PM ET", "",
         ("종료 3-0 승", "Final: W 3-0"), None, None, None),
        ("GB", 1, "reg", 4, "Minn", True, "2031-10-06T09:20:00+09:00", "10/5 (Sun) 8:20 PM ET", "NET1", None, True, None, None),
        ("GB", 2, "reg", 5, "Otters", True, "2031-10-13T05:05:00+09:00", "10/12 (Sun) 4:05 PM ET", "NET2", None, None, None, None),
        ("GB", 3, "reg", 6, None, None, None, None, None, None, None, True, None),
        ("GB", 4, "reg", 17, "Larks", False, None, None, None, None, None, None, True),
        ("MIN", 0, "pre", 2, "Moles", False, "2031-08-21T11:10:00+09:00", "8/20 (Wed) 10:10 PM ET", "",
         ("종료 20-21 패", "Final: L 20-21"), None, None, None),
        ("MIN", 1, "reg", 4, "Bay", False, "2031-10-06T09:20:00+09:00", "10/5 (Sun) 8:20 PM ET", "NET1", None, True, None, None),
        ("MIN", 2, "reg", 5, "Foxes", True, "2031-10-13T05:05:00+09:00", "10/12 (Sun) 4:05 PM ET", "", None, None, None, None),
        ("MIN", 3, "reg", 15, "Owls", False, None, None, None, None, None, None, True),
    ]
    return spark.createDataFrame(rows, DDL)


def test_team_view(spark):
    v = Sc.team_view(season(spark), "GB", "en").orderBy("section", "pos").collect()
    assert [r["kind"] for r in v] == ["game", "game", "game", "bye", "game"]
    assert v[0]["week_label"] == "Pre 2" and v[0]["right_text"] == "Final: W 3-0"
    assert v[1]["tag_text"] == "🏈 Rivalry" and v[1]["matchup"] == "vs Minn" and v[1]["when_text"] == "Mon 10/6 09:20"
    assert v[3]["when_text"] == "Bye Week" and v[3]["week_label"] == "Wk 6"
    assert v[4]["when_text"] == "TBD" and v[4]["sub_text"] == "Time / network TBD"
    ko = Sc.team_view(season(spark), "GB", "ko").orderBy("section", "pos").collect()
    assert ko[0]["week_label"] == "프리 2주" and ko[3]["when_text"] == "바이위크" and ko[1]["home_away"] == "홈"


def test_union_view_order_and_rivalry_once(spark):
    v = Sc.union_view(season(spark), "en").orderBy("section", F.col("date_key").asc_nulls_last(),
                                                    "kind_rank", "pos").collect()
    got = [(r["section"], r["kind"], r["team_label"], r["matchup"]) for r in v]
    assert got == [
        (0, "game", "GB", "vs Herons"), (0, "game", "MIN", "@ Moles"),      # same kickoff: first team first
        (1, "rivalry", "", "MIN @ GB"),                                     # once, from the first team's copy
        (1, "game", "GB", "vs Otters"), (1, "game", "MIN", "vs Foxes"),
        (2, "game", "GB", "@ Larks"), (2, "game", "MIN", "@ Owls"),
    ]
    assert v[2]["home_away"] == "(Green Bay home)"


def test_matchup_check(spark):
    rows = Sc.matchup_check(season(spark)).collect()
    assert [r["consistent"] for r in rows] == [True]
