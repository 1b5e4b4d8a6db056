"""Queries over aligned labels and linguistic features."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonoframe.operators import labels as L
from phonoframe.operators import linguistic
from phonoframe.operators.grouping import PARTS_PER_TASK, tasks_of
from phonoframe.plans.registry import query
from phonoframe.plans.tables import LABELS, events, labels, table
from phonoframe.sources.questions import parse

R = lambda c, n=6: F.round(c, n)


@query(f"WITH {LABELS} SELECT utt, idx, start_time < end_time AND coalesce(lag(end_time) OVER (PARTITION BY utt ORDER BY idx) = start_time, true) AS ok FROM l")
def label_contiguity(spark, sf):
    return L.contiguity(labels(spark, sf)).select("utt", "idx", "ok")


@query(f"WITH {LABELS} SELECT utt, idx, CAST(round_even((start_time+25000)/50000, 0)*50000 AS BIGINT) AS start_time, CAST(round_even((end_time+25000)/50000, 0)*50000 AS BIGINT) AS end_time FROM l")
def label_round(spark, sf):
    shifted = labels(spark, sf).withColumns({c: F.col(c) + 25_000 for c in ("start_time", "end_time")})
    return L.rounded(shifted).select("utt", "idx", "start_time", "end_time")


@query(f"WITH {LABELS}, d AS (SELECT utt, idx, (idx % 3 + 1) * 50000 AS d FROM l) SELECT utt, idx, CAST(sum(d) OVER w - d AS BIGINT) AS start_time, CAST(sum(d) OVER w AS BIGINT) AS end_time FROM d WINDOW w AS (PARTITION BY utt ORDER BY idx)")
def label_set_durations(spark, sf):
    x = labels(spark, sf)
    return L.with_durations(x, x.select("utt", "idx", (F.col("idx") % 3 + 1).alias("frames"))).select("utt", "idx", "start_time", "end_time")


@query(f"WITH {LABELS} SELECT utt, idx FROM l WHERE context LIKE '%-sil%'")
def silence_labels(spark, sf):
    return L.silence_labels(labels(spark, sf))


@query(f"WITH {LABELS} SELECT DISTINCT utt, idx // 5 AS phone FROM l WHERE context LIKE '%-sil%'")
def silence_phones(spark, sf):
    return L.silence_phones(labels(spark, sf))


@query(f"WITH {LABELS} SELECT DISTINCT utt, unnest(range(start_time // 50000, end_time // 50000)) AS frame FROM l WHERE context LIKE '%-sil%'")
def silence_frames(spark, sf):
    return L.silence_frames(labels(spark, sf))


@query(f"""WITH {LABELS}, s AS (SELECT DISTINCT utt, unnest(range(start_time // 50000, end_time // 50000)) AS frame FROM l WHERE context LIKE '%-sil%'),
f AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value FROM events)
SELECT utt, frame, value FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.utt = f.utt AND s.frame = f.frame)""")
def delete_silence(spark, sf):
    return L.without_silence(events(spark, sf).select("utt", "frame", "value"), labels(spark, sf))


@query(f"WITH {LABELS} SELECT utt, count(*) AS num_labels, CAST(least(count(*), 5) AS INTEGER) AS num_states, count(*) // least(count(*), 5) AS num_phones, max(end_time) // 50000 AS num_frames FROM l GROUP BY utt")
def label_counts(spark, sf):
    return L.counts(labels(spark, sf))


@query(f"WITH {LABELS} SELECT utt, string_agg(start_time || ' ' || end_time || ' ' || context, chr(10) ORDER BY idx) AS text FROM l GROUP BY utt")
def label_text(spark, sf):
    return L.as_text(labels(spark, sf))


@query(f"WITH {LABELS} SELECT utt, string_agg(printf('%.4f', start_time*1e-7) || chr(9) || printf('%.4f', end_time*1e-7) || chr(9) || regexp_extract(context, '-([^+]*)\\+', 1), chr(10) ORDER BY idx) AS text FROM l GROUP BY utt")
def label_audacity(spark, sf):
    return L.as_audacity(labels(spark, sf))


_STATES = """s AS (SELECT utt, idx, idx // 5 AS phone, idx % 5 + 1 AS state, (end_time - start_time) // 50000 AS n, start_time // 50000 AS f0 FROM l),
t AS (SELECT *, sum(n) OVER (PARTITION BY utt, phone) AS p, coalesce(sum(n) OVER (PARTITION BY utt, phone ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, max(state) OVER (PARTITION BY utt) AS s FROM s),
x AS (SELECT *, unnest(range(n)) AS i FROM t)"""


@query(f"""WITH {LABELS}, {_STATES} SELECT utt, f0 + i AS frame, round((i+1)/n, 6) AS a, round((n-i)/n, 6) AS b, CAST(n AS DOUBLE) AS c, CAST(state AS DOUBLE) AS d,
CAST(s+1-state AS DOUBLE) AS e, CAST(p AS DOUBLE) AS f, round(n/p, 6) AS g, round((p-i-b)/p, 6) AS h, round((b+i+1)/p, 6) AS i FROM x""")
def subphone_full(spark, sf):
    f = linguistic.state_frames(labels(spark, sf), "full")
    return f.select("utt", "frame", *[R(F.col("features")[k]).alias(c) for k, c in enumerate("abcdefghi")])


@query(f"WITH {LABELS}, {_STATES} SELECT utt, f0 + i AS frame, round((b+i+1)/p, 6) AS a, greatest(1.0, round_even((b+i+1)/p*5, 0)) AS b FROM x")
def subphone_uniform_state(spark, sf):
    f = linguistic.state_frames(labels(spark, sf), "uniform_state")
    return f.select("utt", "frame", *[R(F.col("features")[k]).alias(c) for k, c in enumerate("ab")])


_DENSITY = "round(exp(-0.5*pow(({b}+3/599.0*({o}+floor(200.0/p*(b+i)))-{m})/0.4, 2))/(0.4*sqrt(2*pi())), 6)"


@query(f"WITH {LABELS}, {_STATES} SELECT utt, f0 + i AS frame, {_DENSITY.format(b=-1.5, o=300, m=0)} AS a, {_DENSITY.format(b=-1.0, o=200, m=0.5)} AS b, {_DENSITY.format(b=-0.5, o=100, m=1)} AS c, CAST(p AS DOUBLE) AS d FROM x")
def subphone_coarse_coding(spark, sf):
    f = linguistic.state_frames(labels(spark, sf), "coarse_coding")
    return f.select("utt", "frame", *[R(F.col("features")[k]).alias(c) for k, c in enumerate("abcd")])


@query(f"""WITH {LABELS} SELECT utt, idx // 5 AS phone, {', '.join(f'CAST(coalesce(sum((end_time-start_time)//50000) FILTER (idx % 5 = {k - 1}), 0) AS BIGINT) AS state_{k}' for k in range(1, 6))} FROM l GROUP BY utt, idx // 5""")
def duration_pivot(spark, sf):
    return linguistic.state_durations(labels(spark, sf))


@query(f"WITH {LABELS}, {_STATES} SELECT utt, f0 + i AS frame, CASE WHEN i = n - 1 AND state = s THEN 1 ELSE 0 END AS mark FROM x")
def duration_marks(spark, sf):
    return linguistic.duration_marks(labels(spark, sf), "phoneme")


_SET = """QS "C-click" {*-click+*}
QS "C-any" {*-view+*,*-sil+*}
QS "LL-x" {x^*}
QS "State-2" {*[2]}
CQS "N" {/N:(\\d+)[}
"""


@query(f"""WITH {LABELS} SELECT utt, idx, CAST(contains(context, '-click+') AS INTEGER) AS a, CAST(contains(context, '-view+') OR contains(context, '-sil+') AS INTEGER) AS b,
CAST(starts_with(context, 'x^') AS INTEGER) AS c, CAST(ends_with(context, '[2]') AS INTEGER) AS d, CAST(idx % 7 AS DOUBLE) AS n FROM l""")
def question_answers(spark, sf):
    a = linguistic.answered(labels(spark, sf), *parse(_SET))
    x = F.col("answers")
    return a.select("utt", "idx", *[x[k].cast("int").alias(c) for k, c in enumerate("abcd")], x[4].cast("double").alias("n"))


#: A set of 373 binary and 43 numeric questions over full contexts: five phones of 60, classes of phones, phones along with a number, and 43 numbers.
_NAMES, _FIELDS, _CLASSES, _ALONG = 60, 43, 40, 33
_PLACES = ("{}^*", "*^{}-*", "*-{}+*", "*+{}=*", "*={}@*")


def _full_set() -> str:
    phone = "q{}".format
    lines = [f'QS "{"LL" if k == 0 else "P"}-{k}-{n}" {{{place.format(phone(n))}}}' for k, place in enumerate(_PLACES) for n in range(_NAMES)]
    lines += [f'QS "Class-{j}" {{{",".join(_PLACES[2].format(phone(n)) for n in range(_NAMES) if n % (j + 2) == 1)}}}' for j in range(_CLASSES)]
    lines += [f'QS "Along-{j}" {{*-{phone(j)}+*/F{j}:{2 * j}_*}}' for j in range(_ALONG - 1)] + [f'QS "Last" {{*/F{_FIELDS - 1}:5_}}']
    lines += [f'CQS "F{k}" {{/F{k}:{_group(k)}_}}' for k in range(_FIELDS)]
    return "\n".join(lines)


def _signed(k: int) -> bool:
    return k % 7 == 0


def _group(k: int) -> str:
    return r"([-\d]+)" if _signed(k) else r"(\d+)"


_PHONE = ["(event_id * 7 + user_id) % 60", "(event_id * 11 + 3) % 60", "(event_id * 13 + user_id * 5) % 60", "(event_id + 17) % 60", "(user_id * 3 + event_id) % 60"]
_FIELD = [f"((event_id * {k + 3} + user_id) % 97{' - 48' if _signed(k) else ''})" for k in range(_FIELDS)]
_BITS = [f"p{k} = {n}" for k in range(5) for n in range(_NAMES)] + [f"p2 % {j + 2} = 1" for j in range(_CLASSES)] + [f"p2 = {j} AND f{j} = {2 * j}" for j in range(_ALONG - 1)] + [f"f{_FIELDS - 1} = 5"]


@query(f"""WITH x AS (SELECT event_id, {", ".join(f"{p} AS p{k}" for k, p in enumerate(_PHONE))}, {", ".join(f"{f} AS f{k}" for k, f in enumerate(_FIELD))} FROM events)
SELECT event_id, concat({", ".join(f"CAST({b} AS INTEGER)" for b in _BITS)}) AS bits, concat_ws(',', {", ".join(f"f{k}" for k in range(_FIELDS))}) AS numbers FROM x""")
def question_set(spark, sf):
    """A whole question set of 416 questions over a full context per event."""
    phones = F.expr("concat(" + ", '|', ".join(f"'q', {p}" for p in _PHONE) + ")")
    marks = F.regexp_replace(phones, r"(.*)\|(.*)\|(.*)\|(.*)\|(.*)", r"$1^$2-$3+$4=$5@")
    # One format, as the code of a concatenation this long is too much for the JVM to compile; an unknown event or user has no marks and so no context.
    fields = F.format_string("".join(f"/F{k}:%d_" for k in range(_FIELDS)), *[F.expr(f) for f in _FIELD])
    e = table(spark, sf, "events").select("event_id", "user_id")
    # Files are small and their rows' answers long: the rows, before they get their contexts, are dealt to more tasks than there are files.
    dealt = e.repartition(max(tasks_of(e), PARTS_PER_TASK * spark.sparkContext.defaultParallelism), "event_id")
    a = linguistic.answered(dealt.select("event_id", F.concat(marks, fields).alias("context")), *parse(_full_set()), packed=True)
    return a.select("event_id", "bits", F.array_join(F.col("numbers").cast("array<int>").cast("array<string>"), ",").alias("numbers"))


@query(f"WITH {LABELS} SELECT utt, idx, context FROM l WHERE idx = 3")
def label_index(spark, sf):
    return L.at(labels(spark, sf), 3).select("utt", "idx", "context")


@query(f"WITH {LABELS} SELECT utt, idx, context FROM (SELECT *, count(*) OVER (PARTITION BY utt) AS n FROM l) WHERE idx >= 2 AND idx < n - 3")
def label_slice(spark, sf):
    return L.at(labels(spark, sf), slice(2, -3)).select("utt", "idx", "context")


@query(f"WITH {LABELS} SELECT utt, idx, context FROM (SELECT *, count(*) OVER (PARTITION BY utt) AS n FROM l) WHERE idx IN (0, 4) OR idx = n - 1")
def label_list(spark, sf):
    return L.at(labels(spark, sf), [0, 4, -1]).select("utt", "idx", "context")


@query(f"WITH {LABELS} SELECT utt, idx, start_time, end_time FROM l")
def label_strict(spark, sf):
    """Labels that would fail if one weren't contiguous."""
    return L.strict(labels(spark, sf)).select("utt", "idx", "start_time", "end_time")


_TEXTGRID = """string_agg('        intervals [' || (idx + 1) || ']:' || chr(10) || '            xmin = ' || printf('%.7f', start_time*1e-7) || chr(10) || '            xmax = ' || printf('%.7f', end_time*1e-7) || chr(10)
  || '            text = "' || regexp_extract(context, '-([^+]*)\\+', 1) || '"', chr(10) ORDER BY idx)"""


@query(f"""WITH {LABELS}, t AS (SELECT utt, {_TEXTGRID} AS body, printf('%.7f', max(end_time)*1e-7) AS last, count(*) AS n FROM l GROUP BY utt)
SELECT utt, 'File type = "ooTextFile"' || chr(10) || 'Object class = "TextGrid"' || chr(10) || chr(10) || 'xmin = 0' || chr(10) || 'xmax = ' || last || chr(10) || 'tiers? <exists>' || chr(10) || 'size = 1' || chr(10) || 'item []:' || chr(10)
  || '    item [1]:' || chr(10) || '        class = "IntervalTier"' || chr(10) || '        name = "phoneme"' || chr(10) || '        xmin = 0' || chr(10) || '        xmax = ' || last || chr(10) || '        intervals: size = ' || n || chr(10) || body || chr(10) AS text FROM t""")
def label_textgrid(spark, sf):
    return L.as_textgrid(labels(spark, sf))


@query(f"WITH {LABELS}, {_STATES} SELECT utt, f0 + i AS frame, CAST(state AS DOUBLE) AS a FROM x")
def subphone_state_only(spark, sf):
    return linguistic.state_frames(labels(spark, sf), "state_only").select("utt", "frame", F.col("features")[0].alias("a"))


@query(f"WITH {LABELS}, {_STATES} SELECT utt, f0 + i AS frame, round((b+i+1)/p, 6) AS a FROM x")
def subphone_frame_only(spark, sf):
    return linguistic.state_frames(labels(spark, sf), "frame_only").select("utt", "frame", R(F.col("features")[0]).alias("a"))


@query(f"WITH {LABELS}, {_STATES} SELECT utt, f0 + i AS frame, round((i+1)/n, 6) AS a, CAST(state AS DOUBLE) AS b FROM x")
def subphone_minimal_frame(spark, sf):
    f = linguistic.state_frames(labels(spark, sf), "minimal_frame")
    return f.select("utt", "frame", R(F.col("features")[0]).alias("a"), F.col("features")[1].alias("b"))


def _phones(spark, sf):
    """Phone alignments: a phone for each label, without its state."""
    return labels(spark, sf).withColumn("context", F.regexp_replace("context", r"\[.\]$", ""))


_PHONES = "s AS (SELECT utt, idx, (end_time - start_time) // 50000 AS n, start_time // 50000 AS f0 FROM l), x AS (SELECT *, unnest(range(n)) AS i FROM s)"


@query(f"WITH {LABELS}, {_PHONES} SELECT utt, f0 + i AS frame, round((i+1)/n, 6) AS a, round((n-i)/n, 6) AS b, CAST(n AS DOUBLE) AS c FROM x")
def subphone_minimal_phoneme(spark, sf):
    f = linguistic.phone_frames(_phones(spark, sf), "minimal_phoneme")
    return f.select("utt", "frame", *[R(F.col("features")[k]).alias(c) for k, c in enumerate("abc")])


_PHONE_DENSITY = "round(exp(-0.5*pow(({b}+3/599.0*({o}+floor(200.0/n*i))-{m})/0.4, 2))/(0.4*sqrt(2*pi())), 6)"


@query(f"WITH {LABELS}, {_PHONES} SELECT utt, f0 + i AS frame, {_PHONE_DENSITY.format(b=-1.5, o=300, m=0)} AS a, {_PHONE_DENSITY.format(b=-1.0, o=200, m=0.5)} AS b, {_PHONE_DENSITY.format(b=-0.5, o=100, m=1)} AS c, CAST(n AS DOUBLE) AS d FROM x")
def subphone_coarse_coding_of_phones(spark, sf):
    f = linguistic.phone_frames(_phones(spark, sf), "coarse_coding")
    return f.select("utt", "frame", *[R(F.col("features")[k]).alias(c) for k, c in enumerate("abcd")])


@query(f"WITH {LABELS} SELECT utt, idx AS phone, (end_time - start_time) // 50000 AS frames FROM l")
def duration_of_phones(spark, sf):
    return linguistic.durations(_phones(spark, sf)).select("utt", "phone", F.col("frames")[0].alias("frames"))


_LISTED = "t2 AS (SELECT utt, phone, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (state = {k}), 0) AS BIGINT) AS s{k}" for k in range(1, 6)) + ", CAST(sum(n) AS BIGINT) AS total, max(state) AS states FROM s GROUP BY utt, phone)"
_WHOLE = "(SELECT utt, max(state) AS m FROM s GROUP BY utt)"


def _listed(df):
    """Utterances may end within a phone: what its last states would hold is 0."""
    return df.select("utt", "row", *[F.coalesce(F.get("features", F.lit(k)), F.lit(0)).alias(f"s{k + 1}") for k in range(5)])


@query(f"WITH {LABELS}, {_STATES}, {_LISTED} SELECT x.utt, f0 + i AS \"row\", s1, s2, s3, s4, s5 FROM x JOIN t2 ON t2.utt = x.utt AND t2.phone = x.phone")
def duration_states_by_frame(spark, sf):
    """In every frame, the frames of all states of its phone."""
    return _listed(linguistic.duration_features(labels(spark, sf), size="frame"))


@query(f"WITH {LABELS}, {_STATES}, {_LISTED} SELECT t2.utt, phone AS \"row\", total FROM t2 JOIN {_WHOLE} w ON w.utt = t2.utt AND states = m")
def duration_phone_sums(spark, sf):
    return linguistic.duration_features(labels(spark, sf), unit="phoneme").select("utt", "row", F.col("features")[0].alias("total"))


@query(f"WITH {LABELS}, {_STATES} SELECT utt, f0 + i AS \"row\", CAST(p AS BIGINT) AS total FROM x")
def duration_phone_sums_by_frame(spark, sf):
    return linguistic.duration_features(labels(spark, sf), unit="phoneme", size="frame").select("utt", "row", F.col("features")[0].alias("total"))


@query(f"WITH {LABELS}, {_PHONES} SELECT utt, f0 + i AS \"row\", CAST(CASE WHEN i = n - 1 THEN 1 ELSE 0 END AS BIGINT) AS mark FROM x")
def duration_marks_of_phones(spark, sf):
    """The last frame of each phone of a phone alignment."""
    return linguistic.duration_features(_phones(spark, sf), "binary", "phoneme", "frame").select("utt", "row", F.col("features")[0].alias("mark"))


@query(f"WITH {LABELS}, {_STATES} SELECT utt, f0 + i AS frame, CASE WHEN i = n - 1 THEN 1 ELSE 0 END AS mark FROM x")
def duration_state_marks(spark, sf):
    return linguistic.duration_marks(labels(spark, sf), "state")


@query(f"WITH {LABELS} SELECT DISTINCT utt, true AS state_aligned FROM l UNION ALL SELECT DISTINCT utt + 1000000, false FROM l")
def state_alignment(spark, sf):
    both = labels(spark, sf).unionByName(_phones(spark, sf).withColumn("utt", F.col("utt") + 1_000_000))
    return L.state_aligned(both)


@query(f"""WITH {LABELS}, {_STATES} SELECT x.utt, f0 + i AS frame, CAST(contains(context, '-click+') AS INTEGER) AS a, CAST(contains(context, '-view+') OR contains(context, '-sil+') AS INTEGER) AS b, CAST(starts_with(context, 'x^') AS INTEGER) AS c,
CAST(ends_with(context, '[2]') AS INTEGER) AS d, CAST(x.idx % 7 AS DOUBLE) AS n, round((i+1)/n, 6) AS f, round((b+i+1)/p, 6) AS g FROM x JOIN l ON l.utt = x.utt AND l.idx = x.idx""")
def linguistic_matrix(spark, sf):
    """Answers and sub-phone features of every frame, side by side."""
    x = labels(spark, sf)
    f = linguistic.linguistic_frames(x, linguistic.answered(x, *parse(_SET)), linguistic.state_frames(x, "full"))
    v = F.col("features")
    return f.select("utt", "frame", *[v[k].cast("int").alias(c) for k, c in enumerate("abcd")], v[4].alias("n"), R(v[5]).alias("f"), R(v[13]).alias("g"))


_NUMERIC = """CQS "Signed" {/A:([-\\d]+)_}
CQS "Count" {/B:(\\d+)_}
CQS "Real" {/C:([\\d\\.]+)_}
CQS "Note" {/D:(\\NOTE)_}
CQS "Step" {/E:([pm]\\d+)_}
"""


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -50.0 ELSE CAST(event_id % 9 - 4 AS DOUBLE) END AS a, CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE CAST(event_id % 11 AS DOUBLE) END AS b,
CAST(CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE event_id % 8 + 0.5 END AS DOUBLE) AS c, CAST(CASE WHEN event_id % 5 = 0 THEN -1.0 WHEN event_id % 2 = 0 THEN 69.0 ELSE 58.0 END AS DOUBLE) AS d,
CASE WHEN event_id % 5 = 0 THEN -1.0 WHEN event_id % 3 = 0 THEN CAST(event_id % 6 AS DOUBLE) ELSE CAST(-(event_id % 6) AS DOUBLE) + 0.0 END AS e FROM events""")
def numeric_answers(spark, sf):
    """Signed and unsigned numbers, reals, notes and steps; a fifth of the contexts holds none of them."""
    from phonoframe.plans.tables import table

    i = F.col("event_id")
    text = F.concat(F.lit("x/A:"), (i % 9 - 4).cast("string"), F.lit("_/B:"), (i % 11).cast("string"), F.lit("_/C:"), (i % 8 + 0.5).cast("string"), F.lit("_/D:"), F.when(i % 2 == 0, "A4").otherwise("Bb3"),
                    F.lit("_/E:"), F.when(i % 3 == 0, "p").otherwise("m"), (i % 6).cast("string"), F.lit("_"))
    x = table(spark, sf, "events").select("event_id", F.when(i % 5 == 0, F.lit("x/A:_")).otherwise(text).alias("context"))
    a = linguistic.answered(x, *parse(_NUMERIC)).select("event_id", *[(F.col("answers")[k].cast("double") + 0.0).alias(c) for k, c in enumerate("abcde")])
    return a
