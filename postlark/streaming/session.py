"""A session: take in the posts that match some keywords and report on them."""

import inspect
import threading
from collections import Counter
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from postlark.operators.keywords import keyword_filter, parse_keywords
from postlark.operators.languages import name_languages, with_share
from postlark.operators.words import require_full, top_words
from postlark.schemas import FEED, LANGUAGE_COUNTS, LANGUAGE_DISTRIBUTION, POST, REJECTED, WORD_COUNTS
from postlark.sources.landing import landing_table, read_landing, stream_landing
from postlark.sources.lookup import Lookup
from postlark.sources.posts import read_posts
from postlark.streaming import reports
from postlark.streaming.files import Directory
from postlark.streaming.runs import new_run
from postlark.streaming.snapshots import AppendTable, SnapshotTable, SumTable

# Called with the name of a report, or with that and the numbers of its batch.
OnChange = Callable[[str], None] | Callable[[str, Mapping[str, int]], None]

POLL_SECONDS = 0.5  # how soon a failed query is noticed while waiting for others
SIGNAL_SECONDS = 20  # how long a session that ends waits for the signals of its last batches

# What a session counts of each batch of its source.
METRICS = ("taken", "rejected", "matched")


class _ChangeSignal(StreamingQueryListener):
    """Calls back once per batch with new rows of a session's queries.

    The numbers are those that Spark observed while it ran the batch; they are added up
    for the session whether or not anybody listens.
    """

    def __init__(self, on_change: OnChange | None):
        self.on_change = on_change
        self.run_dir: str | None = None
        self._seen: set[int] = set()
        self._totals: Counter = Counter()
        self._ended: set[str] = set()
        self._lock = threading.Condition()
        try:
            given = list(inspect.signature(on_change).parameters.values()) if on_change else []
        except (TypeError, ValueError):  # a builtin such as print tells nothing about itself
            given = []
        required = [one for one in given if one.default is one.empty and one.kind in (0, 1)]
        self._with_numbers = len(required) == 2

    def begin(self, run_dir: str) -> None:
        with self._lock:
            self.run_dir = run_dir
            self._seen, self._totals = set(), Counter()

    def totals(self) -> dict[str, int]:
        with self._lock:
            return {name: self._totals[name] for name in METRICS}

    def _numbers(self, progress) -> dict[str, int]:
        observed = {}
        for row in progress.observedMetrics.values():
            observed |= {name: row[name] or 0 for name in row.asDict() if name in METRICS}
        return observed

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        report, _, run_dir = (event.progress.name or "").partition(" of ")
        if run_dir != self.run_dir or event.progress.numInputRows == 0:
            return
        numbers = self._numbers(event.progress)
        with self._lock:
            if report == "intake" and event.progress.batchId not in self._seen:
                self._seen.add(event.progress.batchId)
                self._totals.update(numbers)
        if self._with_numbers:
            self.on_change(report, numbers)
        elif self.on_change:
            self.on_change(report)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        with self._lock:
            self._ended.add(str(event.runId))
            self._lock.notify_all()

    def wait_for(self, run_ids: set[str]) -> None:
        """Wait until all signals of some ended queries have come: their end is the last."""
        with self._lock:
            self._lock.wait_for(lambda: run_ids <= self._ended, SIGNAL_SECONDS)


class PostSession:
    """Reports on the posts of a stream of ``schemas.POST`` rows that match some keywords.

    By default one query does it all: it reads the source once, and from each batch of
    matching posts lands the posts and stores feed lines and the counts per language and
    word, which readers add up. Nothing it writes is read again by a stream, and what it
    keeps is merged as it grows, so files and logs stay bounded however long it runs.

    With ``readers="each"`` the session is four queries: ``intake`` filters the source once
    and lands the matching posts; ``languages``, ``words`` and ``feed`` follow the landing
    directory at their own pace. The landing directory then has Spark's own log, which grows
    with the files; ``files_per_batch`` limits those of a batch, ``max_files_per_trigger``
    how many a report takes at once.

    Each start uses new directories and thus counts from zero. ``names`` is a table of
    ``code, name`` or a ``Lookup``, which follows its file. Where the posts have a column
    ``_rejected`` (see ``scan_posts``), its rows are kept apart, to be read with
    ``rejected()``. ``language_trigger`` and ``word_trigger`` pace the queries; a single
    query has the former.

    ``on_change(report)`` is called after each batch that brought a query new rows; a
    function of two arguments also gets the batch's numbers: rows ``taken`` in,
    ``rejected`` and ``matched``, of the query that reads the source. ``metrics()`` has
    their totals. Blank keywords raise ``ValueError``. When a query fails, the session's
    other calls raise its error. ``remove`` deletes the files of a stopped session.
    """

    def __init__(
        self,
        spark: SparkSession,
        posts: DataFrame,
        keywords: str | Sequence[str],
        names: DataFrame | Lookup | None = None,
        k: int = 5,
        landing_format: str = "parquet",
        state_partitions: int | None = None,
        max_files_per_trigger: int | None = None,
        on_change: OnChange | None = None,
        language_trigger: dict = reports.LANGUAGE_TRIGGER,
        word_trigger: dict = reports.WORD_TRIGGER,
        files_per_batch: int | None = None,
        readers: str = "one",
    ):
        parse_keywords(keywords)
        if landing_format not in ("parquet", "csv"):
            raise ValueError("landing_format is 'parquet' or 'csv'")
        if readers not in ("one", "each"):
            raise ValueError("readers is 'one' or 'each'")
        self.spark = spark
        self.posts = posts
        self.keywords = keywords
        self.names = names
        self.k = k
        self.landing_format = landing_format
        self.state_partitions = state_partitions
        self.max_files_per_trigger = max_files_per_trigger
        self.language_trigger = language_trigger
        self.word_trigger = word_trigger
        self.files_per_batch = files_per_batch
        self.readers = readers
        self.queries: dict[str, StreamingQuery] = {}
        self.run_dir: str | None = None
        self._signal = _ChangeSignal(on_change)

    def start(self, once: bool = False) -> dict[str, StreamingQuery]:
        """Start the queries and return them by name.

        With ``once`` the session takes in what the source holds now, and its queries end
        when they have seen it all.
        """
        if any(query.isActive for query in self.queries.values()):
            raise RuntimeError("the session is running; stop it first")
        self.run_dir = new_run(self.spark, "session")
        self.queries = {}
        self._signal.begin(self.run_dir)
        self.spark.streams.addListener(self._signal)
        try:
            trigger = {"availableNow": True} if once else None
            if self.readers == "one":
                self._start_one(trigger)
            else:
                self._start_each(trigger)
        except BaseException:
            self.stop()
            raise
        return self.queries

    def _matching(self) -> DataFrame:
        """The matching posts, and rejected rows if the source has any, counted on the way."""
        has_rejected = REJECTED in self.posts.columns
        bad = F.col(REJECTED).isNotNull() if has_rejected else F.lit(False)
        counted = self.posts.observe(
            "source", F.count_if(~bad).alias("taken"), F.count_if(bad).alias("rejected")
        )
        columns = [*POST.names, REJECTED] if has_rejected else POST.names
        kept = keyword_filter(counted, self.keywords, also=bad).select(columns)
        return kept.observe("intake", F.count_if(~bad).alias("matched"))

    def _table(self, kind: type, name: str, *args, **options):
        return kind(self.spark, f"{self.run_dir}/{name}", *args, **options)

    def _start_one(self, once: dict | None) -> None:
        self._landing = landing_table(
            self.spark, f"{self.run_dir}/landing", self.landing_format, files=self.files_per_batch
        )
        self._feed = self._table(AppendTable, "feed", FEED, files=self.files_per_batch)
        self._rejected = self._table(AppendTable, "rejected", reports.REJECTED_ROWS)
        self._languages = self._table(
            SumTable, "languages", LANGUAGE_COUNTS, key="language", total="tweet_count", files=1
        )
        self._words = self._table(
            SumTable, "words", WORD_COUNTS, key="word", total="word_count", files=self.state_partitions
        )
        self.queries["intake"] = reports.run_session(
            self._matching(),
            {
                "landing": self._landing, "feed": self._feed, "rejected": self._rejected,
                "languages": self._languages, "words": self._words,
            },
            trigger=once or self.language_trigger,
            **self._run("intake"),
        )

    def _start_each(self, once: dict | None) -> None:
        language_trigger = once or self.language_trigger
        word_trigger = once or self.word_trigger
        # A row per language and k words: one file each.
        self._languages = self._table(SnapshotTable, "languages", LANGUAGE_DISTRIBUTION, files=1)
        self._words = self._table(SnapshotTable, "top_words", WORD_COUNTS, files=1)
        self._feed = self._table(AppendTable, "feed", FEED)
        self._rejected = None

        # The reports cannot start on a directory that does not exist yet.
        landing = f"{self.run_dir}/landing"
        Directory(self.spark, landing).create()
        matching = self._matching()
        if REJECTED in matching.columns:
            matching = matching.where(F.col(REJECTED).isNull()).drop(REJECTED)
        self.queries["intake"] = stream_landing(
            matching,
            landing,
            trigger=language_trigger,
            format=self.landing_format,
            files_per_batch=self.files_per_batch,
            **self._run("intake"),
        )
        if once:
            self.queries["intake"].awaitTermination()

        options = {}
        if self.max_files_per_trigger is not None:
            options["maxFilesPerTrigger"] = self.max_files_per_trigger
        if self.landing_format == "csv":
            landed = read_landing(self.spark, landing, stream=True, **options)
        else:
            landed = read_posts(self.spark, landing, "parquet", POST, stream=True, **options)
        self.queries["languages"] = reports.run_language_distribution(
            landed,
            self.names,
            self._languages,
            trigger=language_trigger,
            partitions=self.state_partitions,
            **self._run("languages"),
        )
        self.queries["words"] = reports.run_top_words(
            landed,
            self._words,
            k=self.k,
            trigger=word_trigger,
            partitions=self.state_partitions,
            **self._run("words"),
        )
        self.queries["feed"] = reports.run_feed_table(
            landed, self._feed, trigger=word_trigger, **self._run("feed")
        )

    def _run(self, name: str) -> dict:
        return {
            "checkpoint": f"{self.run_dir}/checkpoints/{name}",
            "name": f"{name} of {self.run_dir}",
        }

    def _raise_failure(self) -> None:
        """Raise the error of a query that has failed."""
        for query in self.queries.values():
            error = query.exception()
            if error is not None:
                raise error

    def await_termination(self) -> None:
        """Wait until every query has ended; when one fails, stop the rest and raise its error."""
        waiting = list(self.queries.values())
        while waiting:
            try:
                self._raise_failure()
                waiting = [query for query in waiting if not query.awaitTermination(POLL_SECONDS)]
            except BaseException:
                self._stop_queries()
                raise

    def _stop_queries(self) -> None:
        for query in self.queries.values():
            query.stop()
        self._signal.wait_for({str(query.runId) for query in self.queries.values()})
        self.spark.streams.removeListener(self._signal)

    def stop(self, drain: bool = False) -> None:
        """Stop all queries; with ``drain``, first report on everything landed.

        Also to be called after a session started with ``once`` has ended. Raises the
        error of a query that failed, after all have stopped.
        """
        intake = self.queries.get("intake")
        if intake is not None:
            if drain and len(self.queries) == 1 and intake.isActive:
                intake.processAllAvailable()
            intake.stop()
        try:
            for name, query in self.queries.items():
                if drain and name != "intake" and query.isActive:
                    query.processAllAvailable()
        finally:
            self._stop_queries()
        self._raise_failure()

    def remove(self) -> None:
        """Delete everything a stopped session has written."""
        if any(query.isActive for query in self.queries.values()):
            raise RuntimeError("the session is running; stop it first")
        if self.run_dir is not None:
            Directory(self.spark, self.run_dir).remove()
        self.run_dir, self.queries = None, {}

    def languages(self) -> DataFrame:
        """Posts per language so far: ``language, tweet_count, share``."""
        self._raise_failure()
        if self.readers == "each":
            return self._languages.read()
        shares = with_share(self._languages.read())
        names = self.names.current() if isinstance(self.names, Lookup) else self.names
        return shares if names is None else name_languages(shares, names)

    def top_words(self, full_only: bool = True) -> DataFrame:
        """The k most frequent words so far; empty while there are fewer than k."""
        self._raise_failure()
        top = self._words.read()
        if self.readers == "one":
            top = top_words(top, self.k)
        return require_full(top, self.k) if full_only else top

    def feed(self) -> DataFrame:
        """All feed lines so far: ``UserID, created_at, line, arrived``.

        Order by ``arrived`` for the order of arrival; lines of one batch share it.
        """
        self._raise_failure()
        return self._feed.read()

    def landed(self) -> DataFrame:
        """The matching posts so far."""
        self._raise_failure()
        if self.readers == "one":
            return self._landing.read()
        landing = f"{self.run_dir}/landing"
        if self.landing_format == "csv":
            return read_landing(self.spark, landing)
        return read_posts(self.spark, landing, "parquet", POST)

    def rejected(self) -> DataFrame:
        """Source rows that could not be read, so far: ``line``; kept with one reader only."""
        self._raise_failure()
        if self._rejected is None:
            raise ValueError("rejected rows are kept by a session with readers='one'")
        return self._rejected.read()

    def metrics(self) -> dict[str, int]:
        """Rows taken in, rejected and matched by the batches reported so far.

        Numbers arrive with a short delay after their batch; ``stop`` waits for the last.
        """
        self._raise_failure()
        return self._signal.totals()
