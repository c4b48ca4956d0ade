"""Note queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memberlens.functions import codes
from memberlens.operators import notes as nt
from memberlens.plans import roles as r
from memberlens.plans.registry import query


def note_members(t):
    """Conversations, documents and pages stand for members; the first letter of the id's digest is the market."""
    conv = t.conversations.select(F.col("conv_id").alias("member_id")).distinct()
    docs = t.documents.select(F.col("doc_id").alias("member_id"))
    return conv.union(docs).distinct().withColumn("market", F.substring(F.md5(F.col("member_id").cast("string")), 1, 1))


def notes(t):
    """Turns, a questionnaire line per turn and the documents, united per member and day."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("turn") / 2).cast("int"))
    turns = t.conversations.select(F.col("conv_id").alias("member_id"), day.alias("note_date"), F.col("text").alias("note"))
    asked = t.conversations.select(F.col("conv_id").alias("member_id"), day.alias("note_date"),
                                   nt.questionnaire_text(F.col("role"), F.length("text")).alias("note"))
    docs = t.documents.select(F.col("doc_id").alias("member_id"), F.lit("2024-02-01").cast("date").alias("note_date"), F.col("text").alias("note"))
    return nt.collected_notes([turns, asked, docs], note_members(t))


NOTES = """
note_members AS (
  SELECT member_id, SUBSTRING(MD5(member_id::VARCHAR), 1, 1) AS market FROM (SELECT conv_id AS member_id FROM conversations UNION SELECT doc_id FROM documents)),
raw_notes AS (
  SELECT conv_id AS member_id, DATE '2024-01-01' + CAST(turn // 2 AS INTEGER) AS note_date, text AS note FROM conversations
  UNION SELECT conv_id, DATE '2024-01-01' + CAST(turn // 2 AS INTEGER), 'question: ' || role || ' ; score : ' || LENGTH(text) FROM conversations
  UNION SELECT doc_id, DATE '2024-02-01', text FROM documents),
notes AS (
  SELECT market, note_date, n.member_id, STRING_AGG(note, ' ' ORDER BY note) AS combined_notes
  FROM raw_notes n JOIN note_members m ON m.member_id = n.member_id WHERE TRIM(note) <> '' GROUP BY 1, 2, 3)"""


@query("k41_collected_notes", r.sql(NOTES, body="SELECT market, note_date, member_id, LENGTH(combined_notes)::INTEGER AS n_chars, MD5(combined_notes) AS digest FROM notes"))
def k41(t):
    return notes(t).select("market", "note_date", "member_id", F.length("combined_notes").alias("n_chars"), F.md5("combined_notes").alias("digest"))


SCORES = r.FEED + """,
scores AS (
  SELECT member_id, LOWER(n_name) AS market, ([%s])[k %% 7 + 1] AS category, k %% 5 + 1 AS score
  FROM feed JOIN customer ON c_custkey = member_id JOIN nation ON n_nationkey = c_nationkey),
base AS (
  SELECT p.member_id, p.market, c.category,
         (SELECT AVG(score) FROM scores s WHERE s.category = c.category) AS population_baseline, mb.b AS market_baseline, ib.b AS individual_baseline
  FROM (SELECT DISTINCT member_id, market FROM scores) p CROSS JOIN (SELECT DISTINCT category FROM scores) c
  LEFT JOIN (SELECT market, category, AVG(score) AS b FROM scores GROUP BY 1, 2) mb ON mb.market = p.market AND mb.category = c.category
  LEFT JOIN (SELECT member_id, category, AVG(score) AS b FROM scores GROUP BY 1, 2) ib ON ib.member_id = p.member_id AND ib.category = c.category)""" % ", ".join(
    f"'{c}'" for c in codes.NOTE_CATEGORIES)


def feed_scores(t):
    market = r.members(t).select("member_id", "market")
    category = F.element_at(F.array(*[F.lit(c) for c in codes.NOTE_CATEGORIES]), F.col("k") % 7 + 1)
    return r.feed(t).join(market, "member_id").select("member_id", "market", category.alias("category"), (F.col("k") % 5 + 1).alias("score"))


@query("k42_category_baselines", r.sql(SCORES, body="""
SELECT member_id, market, category, ROUND(population_baseline, 6) AS population_baseline, ROUND(market_baseline, 6) AS market_baseline,
       ROUND(individual_baseline, 6) AS individual_baseline FROM base"""))
def k42(t):
    out = nt.category_baselines(feed_scores(t))
    return out.select("member_id", "market", "category", *[F.round(c, 6).alias(c) for c in ("population_baseline", "market_baseline", "individual_baseline")])


@query("k42_baseline_objects", r.sql(SCORES, body="""
SELECT member_id, COUNT(individual_baseline)::INTEGER AS own, COUNT(market_baseline)::INTEGER AS in_market, COUNT(population_baseline)::INTEGER AS everywhere FROM base GROUP BY 1"""))
def k42_objects(t):
    objects = nt.baseline_objects(nt.category_baselines(feed_scores(t)))
    size = lambda key: F.size(F.map_keys(F.from_json(F.get_json_object("baselines_json", f"$.{key}"), "map<string,double>")))
    return objects.select("member_id", size("individual_baselines").alias("own"), size("market_baselines").alias("in_market"),
                          size("population_baselines").alias("everywhere"))


@query("k42_baseline_values", r.sql(SCORES, body="""
SELECT member_id, scope, category, ROUND(mean, 6) AS mean FROM (
  SELECT member_id, 'individual_baselines' AS scope, category, individual_baseline AS mean FROM base
  UNION ALL SELECT member_id, 'market_baselines', category, market_baseline FROM base
  UNION ALL SELECT member_id, 'population_baselines', category, population_baseline FROM base) WHERE mean IS NOT NULL"""))
def k42_values(t):
    """What the baseline objects hold, read back from their JSON."""
    objects = nt.baseline_objects(nt.category_baselines(feed_scores(t)))
    scopes = F.from_json("baselines_json", "map<string,map<string,double>>")
    per_scope = objects.select("member_id", F.explode(scopes).alias("scope", "means"))
    return per_scope.select("member_id", "scope", F.explode("means").alias("category", "mean")).withColumn("mean", F.round("mean", 6))


#: Cues that the generated texts do contain.
QUERY_CUES = {
    "Health": (["tion", "heing"], ["idiot", "stupid"]), "Program_Trust": (["thing"], ["loser", "scum"]), "Self": (["license"], ["worthless"]),
    "Risk_Harm": (["token"], ["password"]), "Social_Stability": (["@mail"], ["+1 ("]), "Med_Adherence": (["der "], ["les "]),
    "Care_Engagement": (["que", "user"], ["!!", "ung"]),
}


def _cue(words):
    return " + ".join(f"(CASE WHEN CONTAINS(low, '{w}') THEN 1 ELSE 0 END)" for w in words)


TWO_PASS = NOTES + """,
fit AS (SELECT *, LOWER(combined_notes) AS low FROM notes),
cues AS (""" + " UNION ALL ".join(
    f"SELECT market, note_date, member_id, '{c}' AS category, {_cue(up)} AS up, {_cue(down)} AS down FROM fit" for c, (up, down) in QUERY_CUES.items()) + """),
seeds AS (SELECT *, CASE WHEN up + down > 0 THEN GREATEST(1, LEAST(5, 3 + up - down)) END AS seed FROM cues),
means AS (SELECT member_id, category, AVG(seed) AS own FROM seeds GROUP BY 1, 2)"""


@query("k43_two_pass_scores", r.sql(TWO_PASS, body="""
SELECT market, note_date, s.member_id, s.category,
       CASE WHEN up + down = 1 THEN FLOOR((seed + own) / 2 + 0.5) ELSE seed END::BIGINT AS score,
       (1 + LEAST(up + down, 4))::BIGINT AS confidence, 'PROCESSED' AS processing_status
FROM seeds s JOIN means m ON m.member_id = s.member_id AND m.category = s.category"""))
def k43(t):
    scored = nt.two_pass_scores(notes(t), nt.lexicon_reply(QUERY_CUES), nt.informed_reply(QUERY_CUES))
    return scored.select("market", "note_date", "member_id", "category", "score", "confidence", "processing_status")


@query("k44_reply_parsing", """
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN k < 50 THEN 'Health' ELSE 'Self' END AS category, CASE WHEN event_type = 'click' THEN NULL ELSE k % 5 + 1 END::BIGINT AS score
FROM e WHERE event_type IN ('view', 'purchase', 'click')
UNION ALL SELECT event_id, 'Risk_Harm', 2::BIGINT FROM e WHERE event_type = 'view'""")
def k44(t):
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.when(k < 50, "Health").otherwise("Self")
    one = F.concat(F.lit('{"category":"'), name, F.lit('","score":'), (k % 5 + 1).cast("string"), F.lit("}"))
    two = F.concat(F.lit('{"sentiment_categories":['), one, F.lit(',{"category":"Risk_Harm","score":2},{"category":"Weather","score":9}]}'))
    word = F.concat(F.lit('{"sentiment_categories":[{"category":"'), name, F.lit('","score":"many"}]}'))
    kind = F.col("event_type")
    # a reply inside prose, a bare array, a non-numeric score, and replies that cannot be read
    reply = F.when(kind == "view", F.concat(F.lit("Here it is:\n"), two, F.lit("\nDone."))).when(kind == "purchase", F.concat(F.lit("["), one, F.lit("]"))).when(
        kind == "click", word).when(kind == "error", F.lit('{"sentiment_categories": [oops'))
    replies = t.events.select("event_id", reply.alias("raw_response"))
    return nt.parsed_replies(replies, keep=["event_id"]).select("event_id", "category", "score")


@query("k45_prompt_lookup", "SELECT conv_id, turn, REPLACE(REPLACE('Score seven categories from 1 to 5. Return a JSON array.\nINTERACTION_DATE: {{INTERACTION_DATE}}\n{{NOTES}}', '{{INTERACTION_DATE}}', '2024-01-01'), '{{NOTES}}', text) AS prompt FROM conversations")
def k45(t):
    table = nt.prompt_table(t.spark)
    rows = nt.with_prompt(t.conversations, table, "generator_prompt")
    prompt = nt.fill_template("prompt_template", {"INTERACTION_DATE": F.lit("2024-01-01"), "NOTES": F.col("text")})
    return rows.select("conv_id", "turn", prompt.alias("prompt"))
