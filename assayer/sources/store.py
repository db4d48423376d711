"""A store of its own folder: ledger, blocks, carryover, settings and sealed transcripts as append-only logs.

Nothing is updated in place: a reset, release or new value is another row, and what is in force is read from the logs, so a repeated
write or a lost executor changes no result.  Each part is opened with the key of its own scope; the ledger and its readers
never see content.  Appends to a ledger must come from one writer at a time.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer import schemas
from assayer.functions import digests
from assayer.operators import ledger, policy
from assayer.sources import tables


class Key(NamedTuple):
    """Key material of one scope: ``ledger``, ``transcript`` or ``preference``."""

    scope: str
    secret: bytes


class _Part:
    scope: str

    def __init__(self, spark: SparkSession, path: str, key: Key, form: str = "parquet") -> None:
        if key.scope != self.scope:
            raise PermissionError(f"the {self.scope} part was given a key of scope {key.scope}")
        self.spark, self.path, self.key, self.form = spark, path.rstrip("/"), key, form

    def _log(self, name: str, schema: str) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(self.form).load(f"{self.path}/{name}")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").format(self.form).save(f"{self.path}/{name}")

    def _one(self, name: str, schema: str, **values: Any) -> None:
        made = self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in values))
        self._append(name, made.select(*[F.col(f.split(" ")[0]).cast(f.split(" ", 1)[1]).alias(f.split(" ")[0]) for f in schema.split(", ")]))


LEDGER = schemas.LEDGER
RESETS = "provider_id string, reset_seq long"
CARRYOVER = "provider_id string, clean_remaining int, step long"
RAISES = "provider_id string, response_id string, authority string, raised_at timestamp"
RELEASES = "provider_id string, response_id string, released_at timestamp, released_by string"


class LedgerPart(_Part):
    """Rows of providers in hash chains, their blocks and carryover."""

    scope = "ledger"

    def _resets(self) -> DataFrame:
        return self._log("resets", RESETS).groupBy("provider_id").agg(F.max("reset_seq").alias("seq"))

    def rows(self) -> DataFrame:
        return ledger.after_reset(self._log("ledger", LEDGER), self._resets())

    def append(self, rows: DataFrame) -> None:
        """Rows (provider_id, response_id, at_iso, outcome, score, flags, evaluator_version, taxonomy_version), after those already there.

        Numbers go on over a reset, the chain begins again.
        """
        tables.holds_no_content(rows)
        kept = self._log("ledger", LEDGER).groupBy("provider_id").agg(F.max("seq").alias("last"))
        order = Window.partitionBy("provider_id").orderBy("at_iso", "response_id")
        numbered = rows.withColumn("n", F.row_number().over(order)).join(kept, "provider_id", "left")
        numbered = numbered.withColumn("seq", F.coalesce("last", F.lit(0)) + F.col("n")).withColumn("score", F.col("score").cast("decimal(18,4)"))
        self._append("ledger", ledger.appended(numbered, ledger.heads(self.rows())))

    def head(self, provider: str) -> Any:
        return ledger.heads(self.rows().where(F.col("provider_id") == provider)).first()

    def recent(self, n: int) -> DataFrame:
        return ledger.recent(self.rows(), n)

    def between(self, since_iso: str, until_iso: str) -> DataFrame:
        return self.rows().where((F.col("at_iso") >= since_iso) & (F.col("at_iso") < until_iso))

    def providers(self) -> DataFrame:
        return ledger.providers(self.rows())

    def verify(self) -> DataFrame:
        return ledger.verify(self.rows())

    def reset(self, provider: str | None = None) -> None:
        """Forgets the rows and carryover of one or all providers; open blocks stay until they are released."""
        own = self.rows() if provider is None else self.rows().where(F.col("provider_id") == provider)
        self._append("resets", own.groupBy("provider_id").agg(F.max("seq").alias("reset_seq")))
        gone = self.carryover() if provider is None else self.carryover().where(F.col("provider_id") == provider)
        self._append("carryover", gone.select("provider_id", F.lit(0).alias("clean_remaining"), (F.col("step") + 1).alias("step")))

    def _carried(self) -> DataFrame:
        return tables.latest(self._log("carryover", CARRYOVER), "provider_id", "step")

    def carryover(self) -> DataFrame:
        """(provider_id, clean_remaining, step) in force."""
        return self._carried().where("clean_remaining > 0")

    def set_carryover(self, provider: str, clean_remaining: int) -> None:
        before = self._carried().where(F.col("provider_id") == provider).first()
        self._one("carryover", CARRYOVER, provider_id=provider, clean_remaining=str(clean_remaining), step=str(before["step"] + 1 if before else 0))

    def decay(self, provider: str) -> None:
        now = self.carryover().where(F.col("provider_id") == provider).first()
        if now:
            self.set_carryover(provider, now["clean_remaining"] - 1)

    def raise_block(self, provider: str, response: str, authority: str, at_iso: str) -> None:
        self._one("raises", RAISES, provider_id=provider, response_id=response, authority=authority, raised_at=at_iso)

    def release_block(self, provider: str, response: str, by: str, at_iso: str) -> None:
        self._one("releases", RELEASES, provider_id=provider, response_id=response, released_at=at_iso, released_by=by)

    def blocks(self) -> DataFrame:
        return policy.blocks(self._log("raises", RAISES), self._log("releases", RELEASES))


TURNS = "session_id string, id string, role string, at timestamp, ingest_id long, sealed string"
SPANS = "ref string, response_id string, n_spans int, sealed string"


class TranscriptPart(_Part):
    """Turns and evidence, sealed as they are written by one function and opened only here."""

    scope = "transcript"

    def _sealed(self, text: Column) -> Column:
        return digests.sealed(text, F.lit(self.key.secret))

    def _opened(self) -> Column:
        return digests.opened(F.col("sealed"), F.lit(self.key.secret))

    def put_turns(self, turns: DataFrame) -> None:
        """(session_id, id, role, at, ingest_id, content)."""
        self._append("turns", turns.select("session_id", "id", "role", "at", "ingest_id", self._sealed(F.col("content")).alias("sealed")))

    def put_evidence(self, evidence: DataFrame) -> None:
        """(ref, response_id, spans)."""
        self._append("evidence", evidence.select("ref", "response_id", F.size("spans").alias("n_spans"), self._sealed(F.to_json("spans")).alias("sealed")))

    def session(self, session_id: str) -> DataFrame:
        turns = self._log("turns", TURNS).where(F.col("session_id") == session_id).withColumn("content", self._opened())
        return tables.session_transcript(turns).select("turn_no", "id", "role", "content")

    def content(self) -> DataFrame:
        return self._log("turns", TURNS).select("id", self._opened().alias("content"))

    def evidence(self) -> DataFrame:
        return self._log("evidence", SPANS).select("ref", "response_id", F.from_json(self._opened(), f"array<{schemas.SPAN}>").alias("spans"))

    def stored(self) -> tuple[DataFrame, DataFrame]:
        """Turns and evidence as they lie there, for what counts them."""
        return self._log("turns", TURNS), self._log("evidence", SPANS).withColumn("spans", F.array_repeat(F.lit(1), F.col("n_spans")))


PREFERENCES = "key string, value string, step long"


class PreferencePart(_Part):
    scope = "preference"

    def set(self, key: str, value: str) -> None:
        last = self._log("preferences", PREFERENCES).agg(F.max("step")).first()[0]
        self._one("preferences", PREFERENCES, key=key, value=value, step=str(0 if last is None else last + 1))

    def get(self, key: str) -> str | None:
        found = tables.latest(self._log("preferences", PREFERENCES).where(F.col("key") == key), "key", "step").first()
        return found["value"] if found else None

    def keys(self) -> list[str]:
        return [r["key"] for r in self._log("preferences", PREFERENCES).select("key").distinct().orderBy("key").collect()]


class Store(NamedTuple):
    """The three parts of a store, each with its own key."""

    ledger: LedgerPart
    transcripts: TranscriptPart
    preferences: PreferencePart


def open_store(spark: SparkSession, path: str, secrets: dict[str, bytes], form: str = "parquet") -> Store:
    """The store at ``path`` (``parquet``, ``orc`` or ``json`` files), empty where there is none; ``secrets`` by scope."""
    return Store(*[part(spark, path, Key(part.scope, secrets[part.scope]), form) for part in (LedgerPart, TranscriptPart, PreferencePart)])
