"""Season schedule views: one team's list, and the merged two-team view.

Rows carry their display text and explicit sort keys; ordering is applied by
the caller (a range-partitioned ``orderBy`` over the keys), never by a
single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroll.functions.dates import format_wall_clock

# --- fixed values (must equal the reference): interface labels -----------------
LABELS = {
    "ko": {"home": "홈", "away": "원정", "bye": "바이위크", "tbd_date": "일정 미정",
           "tbd_note": "방송사/시간 시즌 중 확정", "rivalry": "🏈 맞대결",
           "week_pre": "프리", "week_reg": "정규", "week_suffix": "주",
           "home_site": ("(", " 홈)")},
    "en": {"home": "Home", "away": "Away", "bye": "Bye Week", "tbd_date": "TBD",
           "tbd_note": "Time / network TBD", "rivalry": "🏈 Rivalry",
           "week_pre": "Pre", "week_reg": "Wk", "week_suffix": "",
           "home_site": ("(", " home)")},
}
TEAMS = ("GB", "MIN")
HOME_SITES = {"GB": "Green Bay", "MIN": "Minnesota"}
# -------------------------------------------------------------------------------------


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def pick(bilingual: Column, lang: str) -> Column:
    """The text of one language from a {ko, en} struct."""
    return bilingual.getField(lang)


def week_label(lang: str, pre: Column | None = None) -> Column:
    u = LABELS[lang]
    phase_word = (F.lit(u["week_reg"]) if pre is None
                  else F.when(pre, F.lit(u["week_pre"])).otherwise(F.lit(u["week_reg"])))
    return F.concat(phase_word, F.lit(" "), F.col("week").cast("string"), F.lit(u["week_suffix"]))


def game_row(team: Column, lang: str) -> list[Column]:
    """Display columns of an ordinary (or TBD) game row (in ``_DISPLAY`` order)."""
    u = LABELS[lang]
    tbd = _flag("tbd")
    return [
        team,
        F.lit("game"),
        week_label(lang, F.col("phase") == "pre"),
        F.when(tbd, F.lit(u["tbd_date"])).otherwise(format_wall_clock(F.col("dateKST"), lang)),
        F.when(tbd, F.lit(u["tbd_note"])).otherwise(F.col("etLabel")),
        F.concat(F.when(_flag("home"), F.lit("vs")).otherwise(F.lit("@")), F.lit(" "),
                 F.coalesce(F.col("opponent"), F.lit(""))),
        F.when(_flag("home"), F.lit(u["home"])).otherwise(F.lit(u["away"])),
        F.when(F.coalesce(F.col("bcast"), F.lit("")) != "", F.col("bcast"))
         .when(F.col("final").isNotNull(), pick(F.col("final"), lang))
         .otherwise(F.lit("")),
        F.when(_flag("rivalry"), F.lit(u["rivalry"])).otherwise(F.lit("")),
    ]


def bye_row(lang: str) -> list[Column]:
    u = LABELS[lang]
    return [
        F.col("team"), F.lit("bye"),
        week_label(lang), F.lit(u["bye"]),
        F.lit(""), F.lit(""), F.lit(""),
        F.lit(""), F.lit(""),
    ]


def rivalry_row(lang: str) -> list[Column]:
    """The one merged row of a game both teams list, from the first team's copy."""
    u = LABELS[lang]
    first, second = TEAMS
    home = F.when(_flag("home"), F.lit(first)).otherwise(F.lit(second))
    away = F.when(_flag("home"), F.lit(second)).otherwise(F.lit(first))
    site = F.when(_flag("home"), F.lit(HOME_SITES[first])).otherwise(F.lit(HOME_SITES[second]))
    return [
        F.lit(""), F.lit("rivalry"),
        week_label(lang),
        format_wall_clock(F.col("dateKST"), lang),
        F.col("etLabel"),
        F.concat(away, F.lit(" @ "), home),
        F.concat(F.lit(u["home_site"][0]), site, F.lit(u["home_site"][1])),
        F.coalesce(F.col("bcast"), F.lit("")),
        F.lit(u["rivalry"]),
    ]


_DISPLAY = ["team_label", "kind", "week_label", "when_text", "sub_text", "matchup", "home_away",
            "right_text", "tag_text"]


def team_view(games: DataFrame, team: str, lang: str = "en") -> DataFrame:
    """One team's season: pre-season then regular season in list order; byes
    stay as their own rows; rivalry games flagged. One pass over the games."""
    g = games.where((F.col("team") == team) & F.col("phase").isin("pre", "reg")
                    & ~(_flag("bye") & (F.col("phase") == "pre")))
    section = F.when(F.col("phase") == "pre", F.lit(0)).otherwise(F.lit(1))
    is_bye = _flag("bye")
    game, bye = game_row(F.col("team"), lang), bye_row(lang)
    cols = [F.when(is_bye, b).otherwise(c).alias(n) for n, c, b in zip(_DISPLAY, game, bye)]
    return g.select(section.alias("section"), "pos", *cols)


def union_view(games: DataFrame, lang: str = "en") -> DataFrame:
    """Both teams merged: pre-season by kickoff; regular season with rivalry
    games once (first team's copy), byes dropped, sorted by kickoff with ties
    in push order (rivalry, first team, second team, then list order); TBD
    games last, first team first. One pass over the games.

    Sort keys: (section, date_key, kind_rank, pos).
    """
    first, _ = TEAMS
    pre = F.col("phase") == "pre"
    reg = F.col("phase") == "reg"
    rivalry = reg & _flag("rivalry")
    keep = pre | (reg & ~_flag("bye") & (~_flag("rivalry") | (F.col("team") == first)))
    team_rank = F.when(F.col("team") == first, F.lit(1)).otherwise(F.lit(2))
    section = F.when(pre, F.lit(0)).when(_flag("tbd") & ~_flag("rivalry"), F.lit(2)).otherwise(F.lit(1))
    date_key = F.when(section == 2, F.lit(None).cast("string")).otherwise(F.col("dateKST"))
    kind_rank = F.when(rivalry, F.lit(0)).otherwise(team_rank)
    game, riv = game_row(F.col("team"), lang), rivalry_row(lang)
    cols = [F.when(rivalry, r).otherwise(c).alias(n) for n, c, r in zip(_DISPLAY, game, riv)]
    return games.where(keep).select(section.alias("section"), date_key.alias("date_key"),
                                    kind_rank.alias("kind_rank"), "pos", *cols)


def matchup_check(games: DataFrame, keys=("phase", "week", "dateKST")) -> DataFrame:
    """Pairs up the two copies of every rivalry game (full outer equi-join on
    ``keys``) and flags copies without a partner or with equal home flags."""
    first, second = TEAMS
    keys = list(keys)
    a = games.where(_flag("rivalry") & (F.col("team") == first)).select(
        *keys, F.col("home").alias("home_a"), F.lit(True).alias("in_a"))
    b = games.where(_flag("rivalry") & (F.col("team") == second)).select(
        *keys, F.col("home").alias("home_b"), F.lit(True).alias("in_b"))
    j = a.join(b, keys, "full")
    ok = F.coalesce(F.col("in_a") & F.col("in_b") & (F.col("home_a") != F.col("home_b")), F.lit(False))
    return j.select(*keys, ok.alias("consistent"))


UNION_ORDER = ("section", "date_key", "kind_rank", "pos")


def ordered_union(games: DataFrame, lang: str = "en") -> DataFrame:
    """The merged view with its display position ``row_no`` (0-based)."""
    from pressroll.operators.sequence import global_rank
    return global_rank(union_view(games, lang), list(UNION_ORDER))
