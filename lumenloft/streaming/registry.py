"""Cards that are present, as keyed state of a stream, and what happens when one arrives.

`stream_registry` keeps lists for each host, in BUCKETS by card: a card's strong id, else its path, to what is known of it. A host's
cards so don't meet in one task, and a chunk of changes is reduced to a row for each card before the state is asked. It gives the same
registry as the batch fold `feeds.detected_registry`, whatever micro-batches the changes come in: a change counts by its
poll, so that one that comes late neither revives a card that has left nor takes back newer facts. A timer drops cards
that no poll has shown for `absent_ms`."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "host string, key string, path string, label string, known_source_id string, online boolean, poll long"
ENTRY = "card string, poll long, path string, label string, known string, known_poll long, gone long, seen_ms long"
NEVER = -(1 << 62)
BUCKETS = 16
NEW = (NEVER, None, None, None, NEVER, NEVER, 0)


def news_of(changes: pd.DataFrame) -> Iterator[tuple]:
    """What some changes say of each card, whatever was known before: card, the poll of its last departure, the last poll that
    showed it while it wasn't gone, its last arrival after the departure (poll, path, label), and the last source known
    since (known, known_poll). At one poll an arrival comes before a departure, as in the batch fold."""
    texts = changes[["path", "label", "known_source_id"]].astype(object)
    c = texts.where(texts.notna(), None).assign(card=changes["card"], poll=changes["poll"].astype("int64"), late=changes["change"] == "removed")
    c = c.sort_values(["card", "poll", "late"], kind="stable")
    left = c["poll"].where(c["late"], NEVER).groupby(c["card"])
    gone = left.max()

    def last(rows: pd.DataFrame, *columns: str) -> dict[str, tuple]:
        rows = rows.drop_duplicates("card", keep="last")
        return dict(zip(rows["card"].tolist(), zip(*(rows[x].tolist() for x in columns), strict=True), strict=True))

    here = c[~c["late"] & (c["poll"] > left.cummax())]
    shown = last(here, "poll")
    here = here[here["poll"] > here["card"].map(gone)]
    arrived, known = last(here, "poll", "path", "label"), last(here[here["known_source_id"].notna()], "known_source_id", "poll")
    for card, poll in zip(gone.index.tolist(), gone.tolist(), strict=True):
        yield card, poll, *shown.get(card, (NEVER,)), *arrived.get(card, (NEVER, None, None)), *known.get(card, (None, NEVER))


def after(entry: tuple, news: tuple, now: int) -> tuple:
    """A card's entry after what news_of tells of it."""
    poll, path, label, known, known_poll, gone, seen = entry
    left, shown, new_poll, new_path, new_label, new_known, new_known_poll = news
    if shown > gone:
        seen = now
    gone = max(gone, left)
    if poll <= gone:
        poll, path, label = NEVER, None, None
    if known_poll <= gone:
        known, known_poll = None, NEVER
    if new_poll > gone and new_poll >= poll:
        poll, path, label = new_poll, new_path, new_label
    if new_known_poll > gone and new_known_poll >= known_poll:
        known, known_poll = new_known, new_known_poll
    return poll, path, label, known, known_poll, gone, seen


class CardRegistry(StatefulProcessor):
    """Cards of one host, those of one bucket. Departed ones leave the poll of their departure behind, for changes that come late."""

    def __init__(self, absent_ms: int | None = None):
        self.absent_ms = absent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cards = handle.getListState("cards", ENTRY)  # read and written whole: a call for each card takes longer

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs() if self.absent_ms else 0
        held, touched = self._held(), {}
        for changes in rows:
            for card, *news in news_of(changes):
                held[card] = touched[card] = after(held.get(card, NEW), news, now)
        self._hold(held)
        if self.absent_ms and touched:
            self.handle.registerTimer(now + self.absent_ms)
        yield self._told(key[0], touched)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        limit = expiredTimerInfo.getExpiryTimeInMs() - self.absent_ms
        held, left = self._held(), {}
        for card, (poll, *_, gone, seen) in held.items():
            if poll > gone and seen <= limit:
                left[card] = (NEVER, None, None, None, NEVER, poll, seen)
        self._hold(held | left)
        yield self._told(key[0], left)

    def _held(self) -> dict[str, tuple]:
        return {card: tuple(entry) for card, *entry in self.cards.get()} if self.cards.exists() else {}

    def _hold(self, cards: dict[str, tuple]) -> None:
        if cards:
            self.cards.put([(card, *entry) for card, entry in cards.items()])

    @staticmethod
    def _told(host: str, cards: dict[str, tuple]) -> pd.DataFrame:
        rows = [(host, card, path, label, known, poll > gone, max(poll, gone)) for card, (poll, path, label, known, _, gone, _) in cards.items()]
        return pd.DataFrame(rows, columns=["host", "key", "path", "label", "known_source_id", "online", "poll"])

    def close(self) -> None:
        pass


def stream_registry(changes: DataFrame, absent_ms: int | None = None) -> DataFrame:
    """changes(host, poll, change, strong_id, path, label, known_source_id) -> a row for each card that a batch or a timer
    changes. The session needs the RocksDB state store. Checkpoints of rounds 1 to 3 (a map for each host) can't be continued."""
    mode = "ProcessingTime" if absent_ms else "None"
    card = F.coalesce(F.nullif(F.trim("strong_id"), F.lit("")), "path")
    changes = changes.select("host", "poll", "change", "path", "label", "known_source_id", card.alias("card")).filter("card is not null")
    dealt = changes.withColumn("bucket", F.pmod(F.xxhash64("card"), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("host", "bucket").transformWithStateInPandas(CardRegistry(absent_ms), OUT, "Update", mode)


def present(updates: DataFrame, order: str = "at") -> DataFrame:
    """The registry after a table of updates, in the order that they were written: host, key, path, label, known_source_id."""
    last = F.row_number().over(W.partitionBy("host", "key").orderBy(F.desc(order)))
    return updates.withColumn("_n", last).filter("_n = 1 and online").select("host", "key", "path", "label", "known_source_id")


class AutoIngest:
    """Ingests what arrives, for foreachBatch over updates of the registry: one ingest at a time among all drivers of a store,
    and one session for an arrival however often its epoch is replayed.

    A session's id comes from the stream's name, the epoch and the card, so a replay finds the session of the first run: a
    finished one is left alone, and one that a dead driver left is recovered. The lease keeps drivers apart; while another
    holds it the batch fails, and Spark runs it again."""

    def __init__(self, engine, name: str, destination: str, holder: str, ttl_ms: int = 600_000, settings: Callable[[], bool] = lambda: True):
        self.engine, self.name, self.destination, self.holder, self.ttl_ms, self.enabled = engine, name, destination, holder, ttl_ms, settings

    def session_id(self, epoch: int, host: str, key: str) -> str:
        return hashlib.sha256("\0".join((self.name, str(epoch), host, key)).encode()).hexdigest()[:32]

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        arrived = batch.filter("online").select("host", "key", "path", "known_source_id").orderBy("host", "key").collect()  # the cards of one poll
        if not arrived or not self.enabled():
            return
        token = self.engine.store.acquire(f"ingest-{self.name}", self.holder, self.ttl_ms)
        if token is None:
            raise RuntimeError("another driver is ingesting")
        try:
            for r in arrived:
                self._one(self.session_id(epoch, r["host"], r["key"]), r)
        finally:
            self.engine.store.release(f"ingest-{self.name}", self.holder)

    def _one(self, session: str, card) -> None:
        held = self.engine.store.get("ingest_sessions", session).first()
        if held is None:
            strong = None if card["key"] == card["path"] else card["key"]
            self.engine.ingest(card["path"], self.destination, strong_id=strong, source_id=card["known_source_id"], session=session)
        elif held["completed_at"] is None:
            self.engine.recover(session, card["path"])

    def start(self, updates: DataFrame, checkpoint: str):
        return updates.writeStream.outputMode("update").foreachBatch(self).option("checkpointLocation", checkpoint)
