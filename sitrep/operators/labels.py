"""Bulk labelling: rule-based column expressions, and a hook for any other labeller.

The rules are this library's own stand-in for a model. They are deterministic and make no
claim to agree with one.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sitrep import constants as K
from sitrep.functions import predicates as P
from sitrep.functions import text
from sitrep.operators.geo import with_place_intent
from sitrep.session import importable


def label_incident(posts: DataFrame, column: str, min_length: int = 5) -> DataFrame:
    """Adds ``classification_type`` and ``confidence_score``.

    The hazard term named most often decides, ties in the order of the type list; the score is
    its share of all hazard terms. The text is scanned once.
    """
    to_type = text.literal_map(K.HAZARD_LEXICON)
    found = posts.withColumn(
        "_types",
        F.when(
            P.min_text(F.col(column), min_length),
            F.transform(
                text.term_matches(F.col(column), K.HAZARD_LEXICON),
                lambda m: F.element_at(to_type, m),
            ),
        ),
    )

    def tally(kind: str, position: int) -> Column:
        return F.struct(
            F.size(F.filter("_types", lambda t: t == kind)).alias("n"),
            F.lit(-position).alias("rank"),
            F.lit(kind).alias("type"),
        )

    tallies = F.array(*[tally(kind, i) for i, kind in enumerate(K.INCIDENT_TYPES)])
    scored = found.withColumn("_best", F.array_max(tallies))
    named = F.size("_types") > 0
    return scored.withColumns(
        {
            "classification_type": F.when(named, F.col("_best.type")).otherwise(K.NO_INCIDENT),
            "confidence_score": F.when(
                named, F.round(F.col("_best.n") / F.size("_types"), 4)
            ).otherwise(F.lit(1.0)),
        }
    ).drop("_types", "_best")


def label_severity(posts: DataFrame, column: str) -> DataFrame:
    """Adds ``sentiment_label`` and ``confidence_level``: urgent terms, else warning terms,
    else informational."""
    found = posts.withColumn(
        "_found", text.term_matches(F.col(column), [*K.URGENT_TERMS, *K.WARNING_TERMS])
    )
    counted = found.withColumns(
        {
            "_urgent": text.count_in(F.col("_found"), K.URGENT_TERMS),
            "_warning": text.count_in(F.col("_found"), K.WARNING_TERMS),
        }
    )
    urgent, warning = F.col("_urgent"), F.col("_warning")
    total = urgent + warning
    return counted.withColumns(
        {
            "sentiment_label": F.when(urgent > 0, "Urgent")
            .when(warning > 0, "Warning")
            .otherwise("Informational"),
            "confidence_level": F.when(urgent > 0, F.round(urgent / F.nullif(total, F.lit(0)), 4))
            .when(warning > 0, F.lit(1.0))
            .otherwise(F.lit(0.5)),
        }
    ).drop("_urgent", "_warning", "_found")


def label_authenticity(posts: DataFrame, column: str) -> DataFrame:
    """Adds ``check_label`` and ``confidence``.

    Official sources, or a known place with a measure or a first-hand report, are authentic;
    dramatic claims without measure or source are misinformation; the rest is uncertain.
    """
    rows = K.gazetteer_rows()
    low = posts.withColumn("_low", F.lower(F.col(column)))
    cues = [*K.FIRST_HAND_TERMS, *K.OFFICIAL_TERMS, *K.DRAMATIC_TERMS]
    flagged = low.withColumns(
        {
            "_place": text.has_term(F.col("_low"), [n for n, _, _ in rows]),
            "_measure": F.col("_low").rlike(K.MEASURE_PATTERN),
            "_cues": text.term_matches(F.col("_low"), cues),
        }
    )
    place, measure = (F.coalesce(F.col(n), F.lit(False)) for n in ("_place", "_measure"))
    witness, official, dramatic = (
        F.coalesce(text.count_in(F.col("_cues"), terms) > 0, F.lit(False))
        for terms in (K.FIRST_HAND_TERMS, K.OFFICIAL_TERMS, K.DRAMATIC_TERMS)
    )
    evidence = place.cast("int") + measure.cast("int") + witness.cast("int") + official.cast("int")
    label = (
        F.when(dramatic & ~measure & ~official, "MISINFORMATION")
        .when(official | (place & (measure | witness)), "AUTHENTIC")
        .otherwise("UNCERTAIN")
    )
    return flagged.withColumns(
        {"check_label": label, "confidence": F.round(F.lit(0.5) + evidence * F.lit(0.125), 3)}
    ).drop("_low", "_place", "_measure", "_cues")


def topic_phrase(posts: DataFrame, column: str) -> DataFrame:
    """Adds ``topic``: '<incident> in <place>', or the incident alone; null for no incident or
    a text under ten characters."""
    labelled = with_place_intent(label_incident(posts, column), column)
    place = F.when(
        F.col("intent.district") == K.UNKNOWN_DISTRICT, F.col("intent.state")
    ).otherwise(F.col("intent.district"))
    topic = F.when(
        P.min_text(F.col(column), 10) & (F.col("classification_type") != K.NO_INCIDENT),
        F.concat_ws(" in ", "classification_type", place),
    )
    return labelled.withColumn("topic", topic).drop(
        "intent", "classification_type", "confidence_score"
    )


def topic_key(topic: Column) -> Column:
    """Order-free form of a topic: its distinct words without fillers."""
    fillers = text.literal_array(K.TOPIC_FILLERS)
    words = F.split(F.lower(topic), f"[^{text.WORD}]+")
    kept = F.filter(words, lambda w: (w != "") & ~F.array_contains(fillers, w))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def canonical_topics(topics: DataFrame, column: str = "topic") -> DataFrame:
    """``(topic, canonical)``: variants share a key; the longest wording stands for all. A topic of
    nothing but fillers stands for itself.

    Reduced per key before the shuffle; the join back is over distinct topics only.
    """
    distinct = (
        topics.select(F.col(column).alias("topic"))
        .where(F.col("topic").isNotNull() & (F.col("topic") != ""))
        .distinct()
        .withColumn("_words", topic_key(F.col("topic")))
        .withColumn(
            "_key",
            F.when(F.col("_words") != "", F.col("_words")).otherwise(F.concat(F.lit("="), F.col("topic"))),
        )
        .drop("_words")
    )
    best = distinct.groupBy("_key").agg(
        F.max(F.struct(F.length("topic").alias("n"), F.col("topic").alias("t"))).alias("_best")
    )
    return distinct.join(best, "_key").select(
        "topic", F.initcap(F.col("_best.t")).alias("canonical")
    )


class RateLimited(Exception):
    """Raised by a labeller that wants the batch to be tried again later."""


LIMITED = "rate limited"

#: Rows, and MB of them, that a labeller gets at once.
PORTION_ROWS = 1_000
PORTION_MB = 4


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Spark's batches, which are bounded by rows only, in halves until they are small."""
    for batch in batches:
        waiting = [batch]
        del batch
        while waiting:
            part = waiting.pop()
            if part.num_rows > PORTION_ROWS or (part.num_rows > 1 and part.nbytes > PORTION_MB * 1_000_000):
                middle = part.num_rows // 2
                waiting += [part.slice(middle), part.slice(0, middle)]
            elif part.num_rows:
                rows = part.to_pandas(maps_as_pydicts="strict")
                for name in rows.select_dtypes("datetimetz").columns:
                    rows[name] = rows[name].dt.tz_convert("UTC").dt.tz_localize(None)
                yield rows


def _map_portions(
    posts: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType
) -> DataFrame:
    """``mapInPandas`` on portions: only their rows are Python values at a time, however many and
    however long the rows of a batch are. Times are UTC, without a zone."""
    returned = to_arrow_schema(schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in run(_portions(batches)):
            yield from pa.Table.from_pandas(done, schema=returned, preserve_index=False).to_batches()

    return posts.mapInArrow(mapped, schema)


def label_posts(
    posts: DataFrame,
    labeller: Callable[[pd.DataFrame], pd.DataFrame],
    labels: T.StructType,
    key: str = "post_id",
    attempts: int = 3,
    backoff: Callable[[int], float] = lambda attempt: 2.0 ** (attempt + 1),
) -> DataFrame:
    """Run any labeller over batches of rows: ``key``, the label columns, and ``error``.

    A batch has at most ``PORTION_ROWS`` rows and, unless it is one row, ``PORTION_MB``. It is tried again while the labeller reports a rate limit. A batch that fails in any
    other way is halved until the rows that fail stand alone. Rejected rows, and rows that the
    labeller does not return, stay in the result with their error. Concurrency is the number of
    partitions. Select the needed columns and filter before calling.
    """
    importable(posts.sparkSession)
    names = [f.name for f in labels.fields]
    key_type = posts.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, key_type), *labels.fields, T.StructField("error", T.StringType())]
    )
    returned = to_arrow_schema(T.StructType([T.StructField(key, key_type), *labels.fields]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            waiting = [batch]
            while waiting:
                part = waiting.pop()
                done, error = _tried(labeller, part, key, returned, attempts, backoff)
                if done is not None:
                    yield done.assign(error=None)
                    missing = part[~part[key].isin(done[key])]
                    if len(missing):
                        yield _rejected(missing, key, names, "not returned")
                elif len(part) == 1 or error.startswith(LIMITED):
                    yield _rejected(part, key, names, error)
                else:
                    middle = len(part) // 2
                    waiting += [part.iloc[middle:], part.iloc[:middle]]

    return _map_portions(posts, run, schema)


def _tried(
    labeller: Callable[[pd.DataFrame], pd.DataFrame],
    batch: pd.DataFrame,
    key: str,
    returned: pa.Schema,
    attempts: int,
    backoff: Callable[[int], float],
) -> tuple[pd.DataFrame | None, str]:
    """The labeller's rows, or none and what went wrong.

    A frame without one of the columns, with values of another type, with a key twice or with a key
    that was not asked for has gone wrong as well.
    """
    error = ""
    for attempt in range(attempts):
        try:
            done = labeller(batch)[returned.names]
            pa.Table.from_pandas(done, schema=returned, preserve_index=False)
            if done[key].duplicated().any() and not batch[key].duplicated().any():
                raise ValueError("a key is returned twice")
            if not done[key].isin(batch[key]).all():
                raise ValueError("a key is returned that was not asked for")
            return done, ""
        except RateLimited as limited:
            error = f"{LIMITED}: {limited}"
            if attempt + 1 < attempts:
                time.sleep(backoff(attempt))
        except Exception as failed:  # a labeller may fail in any way
            return None, f"{type(failed).__name__}: {failed}"
    return None, error


def _rejected(batch: pd.DataFrame, key: str, names: list[str], error: str | None) -> pd.DataFrame:
    out = pd.DataFrame({key: batch[key]})
    for name in names:
        out[name] = None
    out["error"] = error
    return out


#: Calls that one task may leave behind without an answer before it stops asking.
MAX_LEFT = 32
NOT_ASKED = "not asked: too many calls without an answer"
Labeller = Callable[[pd.DataFrame], pd.DataFrame]


def gather_labels(
    posts: DataFrame,
    labellers: dict[str, tuple[Labeller, T.StructType]],
    key: str = "post_id",
    seconds: float = 30.0,
    rows_at_once: int = 16,
    attempts: int = 3,
    backoff: Callable[[int], float] = lambda attempt: 2.0 ** (attempt + 1),
) -> DataFrame:
    """Ask several labellers about every row at the same time: ``key``, all labels, ``error``.

    ``labellers`` maps a name to a labeller and its columns, which no other may return. All
    labellers get the same ``rows_at_once`` rows together; rows that one has not answered are asked
    again, each alone and at the same time. All or nothing: a row has every label and no error, or no label and an
    error that names what failed: an exception, a malformed or missing answer, or none within
    ``seconds``, repeats after a rate limit included. Write the result before ``split_gathered``
    cuts it in two, or every labeller is asked twice.

    A call cannot be ended from outside: one that is late goes on beside the next ones, and while
    ``MAX_LEFT`` such calls are open a task rejects its rows unasked. So no more calls are open than
    these and ``rows_at_once`` of each labeller.
    """
    importable(posts.sparkSession)
    key_field = T.StructField(key, posts.schema[key].dataType)
    fields = [f for _, kind in labellers.values() for f in kind.fields]
    names = [f.name for f in fields]
    if len({key, "error", *names}) != len(names) + 2:
        raise ValueError("label columns must differ from each other, from the key and from 'error'")
    schema = T.StructType([key_field, *fields, T.StructField("error", T.StringType())])
    asked = {
        name: (labeller, to_arrow_schema(T.StructType([key_field, *kind.fields])))
        for name, (labeller, kind) in labellers.items()
    }

    def ask(name: str, rows: pd.DataFrame, answer: list) -> None:
        labeller, returned = asked[name]
        answer.append(_tried(labeller, rows, key, returned, attempts, backoff))

    def ask_all(questions: list[tuple[str, pd.DataFrame]], late: list[threading.Thread]) -> list[tuple]:
        """The answers that come in time, to questions asked at once; threads without one are ``late``."""
        answers: list[list] = [[] for _ in questions]
        calls = [
            threading.Thread(target=ask, args=(name, rows.copy(), answer), daemon=True)
            for (name, rows), answer in zip(questions, answers, strict=True)
        ]
        for thread in calls:
            thread.start()
        until = time.monotonic() + seconds
        for thread in calls:
            thread.join(max(0.0, until - time.monotonic()))
        # an answer counts if it is there now
        got = [answer[0] if answer else (None, f"no answer within {seconds:g} s") for answer in answers]
        late += [thread for thread, answer in zip(calls, answers, strict=True) if not answer]
        return got

    def labels_of(some: pd.DataFrame, late: list[threading.Thread]) -> tuple[list[dict], list[dict]]:
        """Labels, and errors by labeller, of every row."""
        given: list[dict] = [{} for _ in range(len(some))]
        wrong: list[dict] = [{} for _ in range(len(some))]
        place = {value: i for i, value in enumerate(some[key])}
        single = [(name, i) for name in asked for i in range(len(some))]
        if len(some) > 1 and len(place) == len(some) and not some[key].isna().any():
            single = []
            for name, (done, error) in zip(asked, ask_all([(name, some) for name in asked], late), strict=True):
                missing = set(range(len(some)))
                if done is not None:
                    columns = [c for c in asked[name][1].names if c != key]
                    for value, *row in done[[key, *columns]].itertuples(index=False, name=None):
                        given[place[value]].update(zip(columns, row, strict=True))
                        missing.discard(place[value])
                elif error.startswith(LIMITED):
                    for i in missing:
                        wrong[i][name] = error
                    missing = set()
                single += [(name, i) for i in sorted(missing)]
        if single and len(late) < MAX_LEFT:
            found = ask_all([(name, some.iloc[i : i + 1]) for name, i in single], late)
        else:
            found = [(None, NOT_ASKED)] * len(single)
        for (name, i), (done, error) in zip(single, found, strict=True):
            if done is not None and len(done):
                given[i].update({c: done[c].iat[0] for c in asked[name][1].names if c != key})
            else:
                wrong[i][name] = error or "not returned"
        return given, wrong

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late: list[threading.Thread] = []
        for batch in batches:
            found: dict[str, list] = {name: [] for name in schema.names}
            for at in range(0, len(batch), rows_at_once):
                late[:] = [t for t in late if t.is_alive()]
                some = batch.iloc[at : at + rows_at_once]
                if len(late) < MAX_LEFT:
                    given, wrong = labels_of(some, late)
                else:
                    given, wrong = [{}] * len(some), [dict.fromkeys(asked, NOT_ASKED)] * len(some)
                for value, own, errors in zip(some[key], given, wrong, strict=True):
                    found[key].append(value)
                    found["error"].append("; ".join(f"{n}: {errors[n]}" for n in asked if n in errors) or None)
                    for name in names:
                        found[name].append(None if errors else own.get(name))
            yield pd.DataFrame({name: pd.Series(rows, dtype=object) for name, rows in found.items()})

    return _map_portions(posts, run, schema)


def split_gathered(gathered: DataFrame, key: str = "post_id") -> tuple[DataFrame, DataFrame]:
    """The labelled rows, and ``key`` and ``error`` of the rejected ones."""
    ok = F.col("error").isNull()
    return gathered.where(ok).drop("error"), gathered.where(~ok).select(key, "error")


def split_valid(labelled: DataFrame, column: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with an allowed label and no error, and the rejected rest."""
    ok = F.coalesce(F.col("error").isNull() & F.col(column).isin(allowed), F.lit(False))
    return labelled.where(ok).drop("error"), labelled.where(~ok)
