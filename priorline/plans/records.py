"""Records as they are written, read, rendered and screened: files, JSON, prompts, answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.functions import probability, text
from priorline.operators import playbyplay
from priorline.plans import views
from priorline.plans.registry import Registry
from priorline.session import work_dir
from priorline.sources import files

RECORDS = Registry()
query = RECORDS.query


def _new_path(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("select game_id, game_date, season, home, away, hs, as_ from games where hs <> as_")
def csv_games(spark, sf_dir):
    """Games written as CSV under a fixed header and read back typed: columns in another order, or a value that doesn't fit, fail the read."""
    path = _new_path(spark, "games-csv")
    g = views.games(spark, sf_dir)
    files.write_csv(g, path, "game_id long, game_date date, season int, home int, away int, hs int, as_ int")
    return files.read_csv(spark, path, files.struct("game_id long, game_date date, season int, home int, away int, hs int, as_ int")).where("hs <> as_")


@query("select game_id, season, case when season < 1999 then 'train' when season < 2001 then 'validation' else 'test' end split, case when season < 2001 then hs > as_ end won from games")
def split_publication(spark, sf_dir):
    """Games published by split: labelled ones up to 2000, later ones without their labels, then read back."""
    path = _new_path(spark, "splits")
    split = F.when(F.col("season") < 1999, "train").when(F.col("season") < 2001, "validation").otherwise("test")
    g = views.games(spark, sf_dir).select("game_id", "season", split.alias("split"), F.when(F.col("season") < 2001, F.col("hs") > F.col("as_")).alias("won"))
    g.write.partitionBy("split").json(path)
    return spark.read.schema("game_id long, season int, won boolean, split string").json(path).select("game_id", "season", "split", "won")


@query(
    """select folder, count(*) n, count(distinct snapshot) snapshots, min(report_time) as "first", max(report_time) as "last", sum(minutes_)::bigint as total from (
         select report_time::date::varchar folder, report_time::date::varchar || '/' || (hour(report_time) // 6)::varchar snapshot, report_time, (minutes * 100)::bigint minutes_ from reports) group by 1""",
)
def snapshot_archive(spark, sf_dir):
    """Reports in an archive of folders by day and quarter of a day, read by glob; the file's path tells the snapshot."""
    path = _new_path(spark, "archive")
    r = views.reports(spark, sf_dir).select("report_time", (F.col("minutes") * 100).cast("decimal(20,6)").alias("m"), F.to_date("report_time").cast("string").alias("day"), F.floor(F.hour("report_time") / 6).cast("string").alias("slot"))
    r.select(F.unix_micros("report_time").alias("at"), F.round("m").cast("long").alias("minutes_"), "day", "slot").repartition("day").write.partitionBy("day", "slot").json(path)
    found = files.read_archive(spark, f"{path}/*/*", "at long, minutes_ long").withColumn("folder", F.regexp_extract("_path", r"day=([0-9-]+)", 1))
    snapshot = F.concat_ws("/", "folder", F.regexp_extract("_path", r"slot=(\d+)", 1))
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(snapshot).alias("snapshots"), moment(F.min("at")).alias("first"), moment(F.max("at")).alias("last"), F.sum("minutes_").alias("total"))


@query(
    """select status_ status, count(*) n, count(*) filter (minutes is null) no_minutes from (
         select case when event_id % 29 = 0 then 'unknown' else status end status_, case when event_id % 31 = 0 then null else minutes end as minutes from reports) group by 1"""
)
def report_records(spark, sf_dir):
    """Records to typed rows: those of unknown status are counted apart, missing minutes are told, others stay."""
    told = F.when(F.col("event_id") % 29 == 0, F.lit("Rumoured")).otherwise(F.col("status"))
    raw = views.reports(spark, sf_dir).select(F.to_json(F.struct(told.alias("status"), F.when(F.col("event_id") % 31 != 0, F.col("minutes")).alias("minutes"))).alias("value"))
    typed = raw.select(F.from_json("value", "status string, minutes double").alias("r")).select("r.*")
    known = F.col("status").isin(*views.STATUSES.values())
    return typed.groupBy(F.when(known, F.col("status")).otherwise("unknown").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("minutes").isNull()).alias("no_minutes"))


@query(
    """select game_id, round(h / (h + a), 6) home_p, source from (
         select game_id, source, case when x < 0 then -x / (-x + 100) else 100 / (x + 100) end h, case when y < 0 then -y / (-y + 100) else 100 / (y + 100) end a from (
           select game_id, case when game_id % 3 = 0 then 'close' when game_id % 3 = 1 then 'pick' else 'odds' end source,
                  case when game_id % 3 = 0 then -(105 + game_id % 200) else 100 + game_id % 150 end::double x, -(110 + game_id % 90)::double y from games where game_id % 11 <> 0))"""
)
def market_payloads(spark, sf_dir):
    """Nested quotes in JSON: of three places in a payload the first that has one for both sides, the margin taken out."""
    k = F.col("game_id")
    home = F.when(k % 3 == 0, -(105 + k % 200)).otherwise(100 + k % 150).cast("string")
    side = lambda line: F.struct(line.alias("odds"))
    quote = lambda on: F.when(on & (k % 11 != 0), F.struct(side(home).alias("home"), side((-(110 + k % 90)).cast("string")).alias("away")))
    payload = F.to_json(F.struct(F.struct(quote(k % 3 == 0).alias("close"), quote(k % 3 <= 1).alias("pick"), quote(F.lit(True)).alias("odds")).alias("lines")))
    raw = views.games(spark, sf_dir).select("game_id", payload.alias("payload"))
    kind = "struct<home:struct<odds:string>,away:struct<odds:string>>"
    parsed = raw.select("game_id", F.from_json("payload", f"lines struct<close:{kind},pick:{kind},odds:{kind}>")["lines"].alias("l"))
    each = F.array(*[F.when(F.col("l")[s].isNotNull(), F.struct(F.lit(s).alias("source"), F.col("l")[s]["home"]["odds"].cast("double").alias("h"), F.col("l")[s]["away"]["odds"].cast("double").alias("a"))) for s in ("close", "pick", "odds")])
    first = parsed.select("game_id", F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0)).alias("x")).where("x is not null").select("game_id", "x.*")
    h, a = probability.implied_probability(F.col("h")), probability.implied_probability(F.col("a"))
    return first.select("game_id", F.round(h / (h + a), 6).alias("home_p"), "source")


@query(
    """select g.game_id, sha256('{"away":' || away || ',"date":"' || game_date || '","home":' || home || ',"season":' || season || '}') digest, true same from games g"""
)
def canonical_json(spark, sf_dir):
    """Records as JSON with sorted keys and no spaces, its digest, and whether parsing and rendering it gives it again."""
    fields = F.struct(F.col("away"), F.col("game_date").cast("string").alias("date"), F.col("home"), F.col("season"))
    g = views.games(spark, sf_dir).select("game_id", F.to_json(fields).alias("j"))
    again = F.to_json(F.from_json("j", "away int, date string, home int, season int"))
    return g.select("game_id", F.sha2("j", 256).alias("digest"), (again == F.col("j")).alias("same"))


_STRICT = """case when event_id % 5 = 0 then 'repeated key' when event_id % 5 = 1 then 'not finite' when event_id % 5 = 2 then 'wrong type' when event_id % 5 = 3 then 'other keys' else 'ok' end"""


@query(f"select {_STRICT} verdict, count(*) n from events group by 1")
def strict_json(spark, sf_dir):
    """Lines of JSON by what is wrong with them: a key twice, a number that isn't finite, a wrong type, other keys."""
    k = F.col("event_id")
    number, name = F.col("value").cast("decimal(20,4)").cast("string"), F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    line = (
        F.when(k % 5 == 0, F.concat(F.lit('{"name":'), name, F.lit(',"value":1,"value":'), number, F.lit("}")))
        .when(k % 5 == 1, F.concat(F.lit('{"name":'), name, F.lit(',"value":NaN}')))
        .when(k % 5 == 2, F.concat(F.lit('{"name":'), name, F.lit(',"value":"'), number, F.lit('"}')))
        .when(k % 5 == 3, F.concat(F.lit('{"title":'), name, F.lit(',"value":'), number, F.lit("}")))
        .otherwise(F.concat(F.lit('{"name":'), name, F.lit(',"value":'), number, F.lit("}")))
    )
    raw = views.table(spark, sf_dir, "events").select(line.alias("line"))
    return raw.select(files.strict_verdict(F.col("line"), {"name": "string", "value": "number"}).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""
    select game_id, lpad(away::varchar, 2, '0') || '@' || lpad(home::varchar, 2, '0') matchup, lpad(away::varchar, 2, '0') away, lpad(home::varchar, 2, '0') home, true whole from games""")
def matchup_parts(spark, sf_dir):
    """'AWAY@HOME' cut in two; anything but two names is no matchup."""
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    g = views.games(spark, sf_dir).select("game_id", F.concat(two("away"), F.lit("@"), two("home")).alias("matchup"))
    parts = F.split("matchup", "@")
    return g.select("game_id", "matchup", parts[0].alias("away"), parts[1].alias("home"), ((F.size(parts) == 2) & (parts[0] != "") & (parts[1] != "")).alias("whole"))


@query("""
    select game_id, round(exp(a) / (exp(a) + exp(b)), 6) forward, round((exp(a) / (exp(a) + exp(b)) + 1 - exp(c) / (exp(c) + exp(b))) / 2, 6) average from (
      select game_id, ln(p) a, ln(1 - p) b, ln(1 - p) + (game_id % 7) / 50.0::double c from forecasts)""")
def label_softmax(spark, sf_dir):
    """Probabilities from two labels' scores, and the average of both orientations."""
    f = views.forecasts(spark, sf_dir).select("game_id", F.ln("p").alias("a"), F.ln(1 - F.col("p")).alias("b"), (F.ln(1 - F.col("p")) + (F.col("game_id") % 7).cast("double") / 50.0).alias("c"))
    first = lambda x, y: probability.softmax(F.array(x, y))[0]
    forward, back = first(F.col("a"), F.col("b")), first(F.col("c"), F.col("b"))
    return f.select("game_id", F.round(forward, 6).alias("forward"), F.round((forward + 1 - back) / 2, 6).alias("average"))


@query("""
    select game_id, case game_id % 4 when 0 then round(p, 4) when 1 then null when 2 then null else round(p, 4) end probability,
           case game_id % 4 when 1 then 'no object' when 2 then 'outside 0 to 1' end failure from (select game_id, printf('%.4f', p)::double p from forecasts)""")
def response_parse(spark, sf_dir):
    """Prompts in JSON and answers to them, of which only an object with a probability from 0 to 1 counts."""
    p = F.format_string("%.4f", "p")
    k = F.col("game_id") % 4
    said = F.when(k == 0, F.concat(F.lit('{"probability": '), p, F.lit("}"))).when(k == 1, p).when(k == 2, F.concat(F.lit('{"probability": 1'), p, F.lit("}"))).otherwise(F.concat(F.lit('ok then {"probability":'), p, F.lit("}\n")))
    f = views.forecasts(spark, sf_dir).select("game_id", said.alias("said"))
    return f.select("game_id", *text.parsed_answer(F.col("said")))


@query("select event_id, regexp_replace(regexp_replace(lower('Run ' || event_type || '/' || user_id::varchar || ' #' || event_id::varchar), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') name from events")
def safe_names(spark, sf_dir):
    """Names with nothing but small letters, digits and single dashes."""
    raw = F.concat(F.lit("Run "), "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit(" #"), F.col("event_id").cast("string"))
    return views.table(spark, sf_dir, "events").select("event_id", text.safe_name(raw).alias("name"))


@query("""
    select conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g') parted,
           len([x for x in string_split(coalesce(text, ''), chr(10)) if not regexp_matches(x, '^\\s*[Pp]age [0-9]+( of [0-9]+)?\\s*$')])::bigint as lines from conversations""")
def glued_names(spark, sf_dir):
    """Gaps put between glued names and numbers, and the lines that are no page markers."""
    t = F.coalesce("text", F.lit(""))
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.parted(t).alias("parted"), F.size(text.without_page_marks(t)).cast("long").alias("lines"))


@query("""
    select team, day, string_agg(status || ': ' || names, '; ' order by k) listing from (
      select team, day, status, list_position(['Out', 'Doubtful', 'Questionable', 'Probable', 'Available'], status) k, string_agg('player ' || lpad(player::varchar, 6, '0'), ', ' order by player) names from (
        select team, report_time::date as day, player, max_by(status, (report_time, event_id)) status from reports group by 1, 2, 3) group by 1, 2, 3) group by 1, 2""")
def status_listing(spark, sf_dir):
    """A team's players of a day by their last status, in fixed words and order."""
    last = views.reports(spark, sf_dir).groupBy("team", F.to_date("report_time").alias("day"), "player").agg(F.max_by("status", F.struct("report_time", "event_id")).alias("status"))
    named = last.groupBy("team", "day", "status").agg(F.array_join(F.transform(F.array_sort(F.collect_list("player")), lambda p: F.concat(F.lit("player "), F.lpad(p.cast("string"), 6, "0"))), ", ").alias("names"))
    order = F.array_position(F.array(*[F.lit(x) for x in ("Out", "Doubtful", "Questionable", "Probable", "Available")]), F.col("status"))
    rows = named.groupBy("team", "day").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), F.concat("status", F.lit(": "), "names").alias("line")))).alias("x"))
    return rows.select("team", "day", F.array_join(F.transform("x", lambda r: r["line"]), "; ").alias("listing"))


@query("select event_id, event_type label, list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type)::int code, true whole from events")
def label_round_trip(spark, sf_dir):
    """Labels to codes and back."""
    labels = F.array(*[F.lit(x) for x in views.STATUSES])
    e = views.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"), F.array_position(labels, F.col("event_type")).cast("int").alias("code"))
    return e.withColumn("whole", F.element_at(labels, F.col("code")) == F.col("label"))


@query("""
    select event_id, case when event_id % 6 = 0 then 'no licence' when event_id % 4 = 0 then 'expired' when event_id % 9 = 0 then 'not yet' end refused from events
    where event_id % 6 = 0 or event_id % 4 = 0 or event_id % 9 = 0""")
def permissions(spark, sf_dir):
    """Rows that may not be used at their moment: no licence, one that has ended, one that begins later."""
    k, at = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    day = 86_400_000_000
    e = views.table(spark, sf_dir, "events").select("event_id", at.alias("at"), (k % 6 != 0).alias("licensed"), F.when(k % 9 == 0, at + day).otherwise(at - day).alias("since"), F.when(k % 4 == 0, at - 1).otherwise(at + day).alias("until"))
    why = F.when(~F.col("licensed"), "no licence").when(F.col("until") < F.col("at"), "expired").when(F.col("since") > F.col("at"), "not yet")
    return e.select("event_id", why.alias("refused")).where("refused is not null")


@query("""
    select 'g-' || substr(sha256('v1:' || game_id::varchar), 1, 16) question_id, 'Will team ' || home || ' beat team ' || away || '?' prompt, null::boolean answer from games where season >= 2001
    union all select 'g-' || substr(sha256('v1:' || game_id::varchar), 1, 16), 'Will team ' || home || ' beat team ' || away || '?', hs > as_ from games where season < 2001""")
def prompts_and_answers(spark, sf_dir):
    """Prompts and answers written apart and joined again by question: later seasons have prompts only."""
    path = _new_path(spark, "questions")
    key = F.concat(F.lit("g-"), F.substring(F.sha2(F.concat(F.lit("v1:"), F.col("game_id").cast("string")), 256), 1, 16)).alias("question_id")
    prompt = F.concat(F.lit("Will team "), F.col("home").cast("string"), F.lit(" beat team "), F.col("away").cast("string"), F.lit("?")).alias("prompt")
    g = views.games(spark, sf_dir)
    files.write_once(g.select(key, prompt), f"{path}/prompts")
    files.write_once(g.where("season < 2001").select(key, (F.col("hs") > F.col("as_")).alias("answer")), f"{path}/answers")
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    return read("prompts", "question_id string, prompt string").join(read("answers", "question_id string, answer boolean"), "question_id", "left").select("question_id", "prompt", "answer")


@query("""
    select conv_id, count(*) turns, count(*) filter (role = 'assistant') answers, max_by(role, turn) last_role, bool_and(role in ('system', 'user', 'assistant')) known
    from conversations group by 1""")
def chat_records(spark, sf_dir):
    """Turns gathered to one chat record a conversation, written, read again and described."""
    path = _new_path(spark, "chats")
    c = views.table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")
    files.write_once(c.groupBy("conv_id").agg(turns), path)
    read = spark.read.schema("conv_id long, messages array<struct<turn:long,role:string,text:string>>").json(path)
    roles = F.transform("messages", lambda m: m["role"])
    return read.select("conv_id", F.size("messages").cast("long").alias("turns"), F.size(F.filter(roles, lambda r: r == "assistant")).cast("long").alias("answers"), F.element_at(roles, -1).alias("last_role"), F.forall(roles, lambda r: r.isin("system", "user", "assistant")).alias("known"))


@query("""
    select game_id, case when game_id % 17 = 0 then null else round((p + 1 - q) / 2, 6) end probability, case when game_id % 17 = 0 then null else round(abs(p + q - 1), 6) end gap,
           case when game_id % 34 = 0 then 'timeout' when game_id % 17 = 0 then 'no answer' end reason from (select game_id, p, 1 - p + (game_id % 5) / 100.0::double q from forecasts)""")
def terminal_rows(spark, sf_dir):
    """Finished work: scores and the gap between orientations where it succeeded, else the reason and nothing else."""
    k = F.col("game_id")
    f = views.forecasts(spark, sf_dir).select("game_id", "p", (1 - F.col("p") + (k % 5).cast("double") / 100.0).alias("q"), F.when(k % 34 == 0, "timeout").when(k % 17 == 0, "no answer").alias("reason"))
    done = F.col("reason").isNull()
    return f.select("game_id", F.when(done, F.round((F.col("p") + 1 - F.col("q")) / 2, 6)).alias("probability"), F.when(done, F.round(F.abs(F.col("p") + F.col("q") - 1), 6)).alias("gap"), "reason")


@query("""
    select season, count(*) n, count(*) filter (kept) kept from (
      select ('20' || substr(code, 4, 2))::int season, substr(code, 1, 3) = '002' kept from (
        select lpad(case when game_id % 3 = 0 then '4' else '2' end || lpad((season % 100)::varchar, 2, '0') || lpad((game_id % 10000)::varchar, 5, '0'), 10, '0') code from games)) group by 1""")
def regular_season(spark, sf_dir):
    """Ten-digit codes: the first three tell regular-season games, the next two the season."""
    kind = F.when(F.col("game_id") % 3 == 0, "4").otherwise("2")
    code = F.lpad(F.concat(kind, F.lpad((F.col("season") % 100).cast("string"), 2, "0"), F.lpad((F.col("game_id") % 10000).cast("string"), 5, "0")), 10, "0")
    g = views.games(spark, sf_dir).select(code.alias("code"))
    return g.groupBy(F.concat(F.lit("20"), F.substring("code", 4, 2)).cast("int").alias("season")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.substring("code", 1, 3) == "002").alias("kept"))


@query("""
    select label, count(*) n, count(*) filter (year(game_date) + case when month(game_date) >= 7 then 1 else 0 end <> label) wrong from (
      select *, season + case when game_id % 97 = 0 then 1 else 0 end label from games) group by 1""")
def season_labels(spark, sf_dir):
    """Rows whose label isn't the season of their date."""
    from priorline.functions.calendar import season

    g = views.games(spark, sf_dir).withColumn("label", F.col("season") + F.when(F.col("game_id") % 97 == 0, 1).otherwise(0))
    return g.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(season(F.col("game_date")) != F.col("label")).alias("wrong"))


@query("""
    select vec_id, round(sqrt(list_sum([x::double * x::double for x in embedding])), 6) whole, round(sqrt(list_sum([x::double * x::double for x in embedding[1:32]])), 6) low_family,
           round(sqrt(list_sum([x::double * x::double for x in embedding[33:64]])), 6) high_family from embeddings""")
def ablation(spark, sf_dir):
    """A vector with one family of its columns set to 0 at a time: what is left of its length."""
    length = lambda keep: F.round(F.sqrt(F.aggregate(F.transform("embedding", lambda x, i: F.when(keep(i), x.cast("double")).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x * x)), 6)
    return views.table(spark, sf_dir, "embeddings").select("vec_id", length(lambda i: i >= 0).alias("whole"), length(lambda i: i < 32).alias("low_family"), length(lambda i: i >= 32).alias("high_family"))


def _plays(spark, sf_dir) -> DataFrame:
    """An order's lines as a game's events: kinds, sides and misses by key."""
    li, g = views.table(spark, sf_dir, "lineitem"), views.games(spark, sf_dir).select("game_id", "home", "away")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    side = F.when(F.col("l_suppkey") % 2 == 0, F.col("home")).otherwise(F.col("away")).cast("string")
    miss = F.when(F.col("l_partkey") % 2 == 0, "MISS").otherwise("")
    li = li.select("l_orderkey", "l_suppkey", "l_partkey", F.row_number().over(order).cast("long").alias("num"))
    return li.join(g, li["l_orderkey"] == g["game_id"]).select("game_id", "num", (F.col("l_partkey") % 5 + 1).cast("int").alias("kind"), miss.alias("home_text"), F.lit("").alias("away_text"), side.alias("t1"))


@query(
    """select game_id, t1 team, count(*) filter (kind in (1, 2)) fga, count(*) filter (kind = 3) fta, count(*) filter (kind = 4 and open_ = t1) oreb, count(*) filter (kind = 5) tov,
              round(count(*) filter (kind in (1, 2)) + 0.44 * count(*) filter (kind = 3) - count(*) filter (kind = 4 and open_ = t1) + count(*) filter (kind = 5), 6)::double possessions
       from (select *, last_value(mark ignore nulls) over (partition by game_id order by num rows between unbounded preceding and 1 preceding) open_ from plays) group by 1, 2""",
    """plays as (select *, case when kind = 2 or (kind = 3 and miss) then t1 when kind in (1, 4) then '' end mark from (
         select l_orderkey game_id, (l_partkey % 5 + 1)::int kind, l_partkey % 2 = 0 miss, (case when l_suppkey % 2 = 0 then home else away end)::varchar t1,
                row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate) num from lineitem join games on game_id = l_orderkey))""",
)
def play_totals(spark, sf_dir):
    """Shots, free throws, offensive rebounds, turnovers and possessions of both sides from a game's events."""
    out = playbyplay.team_totals(_plays(spark, sf_dir))
    return out.select("game_id", "team", "fga", "fta", "oreb", "tov", F.round("possessions", 6).alias("possessions"))


@query("""
    select c_custkey, array_to_string(list_sort([x for x in regexp_split_to_array(regexp_replace(lower(n), '[.'']', '', 'g'), '[^a-z0-9]+') if x <> '']), ' ') name_key from (
      select c_custkey, case when c_custkey % 2 = 0 then replace(c_name, '#', ', O''') || ' Jr.' else replace(c_name, '#', ' o') || ' JR' end n from customer)""")
def person_keys(spark, sf_dir):
    """Keys in which the order of names, dots, apostrophes and case make no difference."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.replace("c_name", F.lit("#"), F.lit(", O'")), F.lit(" Jr."))).otherwise(F.concat(F.replace("c_name", F.lit("#"), F.lit(" o")), F.lit(" JR")))
    return views.table(spark, sf_dir, "customer").select("c_custkey", text.person_key(name).alias("name_key"))


@query("select day, row_number() over (order by day) - 1 as number, count(*) n, count(*) = 0 empty from (select report_time::date as day from reports) group by 1")
def crawl_manifest(spark, sf_dir):
    """A manifest of the days of a crawl with dense numbers in order, a row for each day."""
    days = views.reports(spark, sf_dir).groupBy(F.to_date("report_time").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.select("day", (F.row_number().over(Window.orderBy("day")) - 1).cast("long").alias("number"), "n", (F.col("n") == 0).alias("empty"))


@query("""
    select user_id, count(*) filter (event_type = 'signup') finals, max(event_id) filter (event_type = 'signup') = max(event_id) last_is_final, count(*) filter (event_type = 'signup') = 1 and max(event_id) filter (event_type = 'signup') = max(event_id) valid
    from events group by 1""")
def final_records(spark, sf_dir):
    """Each log's record named final: there has to be one, and it has to be the last line."""
    final = F.col("event_type") == "signup"
    e = views.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(final).alias("finals"), (F.max(F.when(final, F.col("event_id"))) == F.max("event_id")).alias("last_is_final"))
    return e.withColumn("valid", (F.col("finals") == 1) & F.col("last_is_final"))
