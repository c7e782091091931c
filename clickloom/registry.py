"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from clickloom import schemas
from clickloom.fixtures import VIEWS, base_table, direct_views, reads, run, view
from clickloom.functions import rules
from clickloom.operators import accounts, chat, clicks, links, payloads, traffic
from clickloom.sources import tables, text
from clickloom.sources.buckets import Buckets
from clickloom.sources.snapshots import Snapshot
from clickloom.storage import new_folder, stage, staged, work_folder
from clickloom.streaming import chat as live_chat
from clickloom.streaming import clicks as live_clicks
from clickloom.streaming import runner
from clickloom.streaming import traffic as live_traffic

HOST = "links.example"
CODE_SALT = "salt"

# The given events are too sparse for the real limit of 20 per minute.
LIMIT = {"window_seconds": 86400, "max_hits": 2}

# Streams whose rule needs events in time order run in so many micro-batches; all take
# so many files at once.
MICRO_BATCHES = 4
FILES_PER_BATCH = 4

# Live events arrive up to so much later than they happen; streams wait for them.
LATE_SECONDS = 86_400
DELAY = "1 day"
FAR_TIME = "2262-01-01 00:00:00"
# Events of a group that a stream in order of time takes at once, each some dozens of bytes.
EVENTS_AT_ONCE = 100_000
# Changes of a page of the presence log; the given tables have too few for the usual size.
PRESENCE_PAGE = 500
# Buckets of the clicks stored by code.
CLICK_BUCKETS = 16
# Ids of a range of the live clicks; the given tables have too few for the usual width.
CLICK_RANGE = 10_000
# The longest time a chat connection stays open.
LONGEST = "1 DAY"

# Views whose rows cost much to judge are stored in a file per core.
SPREAD = ["chat_conns", "chat_frames", "http_requests"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_BUCKETED: dict[tuple[str, str], str] = {}


class _Views:
    """Fixture views of one scale as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self.stored(name, lambda: self._built(name))

    def _built(self, name: str) -> DataFrame:
        built = view(self.spark, self.sf_dir, name, self._inputs(name))
        return self.spread(built) if name in SPREAD else built

    def _inputs(self, name: str) -> dict[str, DataFrame]:
        """The stored fixture views that a view reads directly."""
        return {v: getattr(self, v) for v in direct_views(name)}

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return stage(self.spark, self.sf_dir, name, build)

    def spread(self, rows: DataFrame) -> DataFrame:
        """Rows in a part per core: what is read of a few large row groups would be as few tasks."""
        return rows.repartition(self.spark.sparkContext.defaultParallelism)

    def stored_by_day(self, name: str) -> tuple[str, StructType]:
        """Folder and layout of a view kept in one folder per day."""
        rows = getattr(self, name)
        folder = new_folder(self.spark, f"{name}-by-day")
        tables.write_clicks(rows, folder, replace=True)
        return folder, rows.schema

    def stream(self, name: str) -> DataFrame:
        """The files of a stored view as a stream."""
        build = (
            self._admitted
            if name == "admissions"
            else (lambda: self._built(name))
        )
        path, schema = staged(self.spark, self.sf_dir, name, build)
        return runner.read_stream(self.spark, path, schema, FILES_PER_BATCH)

    def stream_in_time(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Rows with a time `ts` as a stream of MICRO_BATCHES, cut between instants."""
        slot = f"{name}-in-time"
        rows = self.stored(f"{slot}-rows", build)
        ends = rows.agg(F.min(rules.micros(F.col("ts"))), F.max(rules.micros(F.col("ts")))).first()
        folder = new_folder(self.spark, slot)
        step = (ends[1] - ends[0]) // MICRO_BATCHES + 1 if ends[0] is not None else 1
        place = F.floor((rules.micros(F.col("ts")) - F.lit(ends[0] or 0)) / F.lit(step))
        for k in range(MICRO_BATCHES):
            part = rows.filter(place == k).repartition(FILES_PER_BATCH)
            part.write.mode("append").parquet(folder)
        return runner.read_stream(self.spark, folder, rows.schema, FILES_PER_BATCH)

    def stream_out_of_order(
        self, name: str, build: Callable[[], DataFrame], ids: list[str], tick: dict[str, str] | None = None
    ) -> DataFrame:
        """Rows with a time `ts` as a stream of MICRO_BATCHES, in order of arrival.

        A row arrives up to LATE_SECONDS after its time, by a hash of `ids`, so batches
        overlap in time and split instants. A last row, with a far time and the values
        of `tick`, moves the clock on.
        """
        slot = f"{name}-arriving"
        rows = self.stored(f"{slot}-rows", build)
        late = F.pmod(F.xxhash64(*ids), F.lit(LATE_SECONDS * 1_000_000))
        arrival = rules.micros(F.col("ts")) + late
        first, last = rows.agg(F.min(arrival), F.max(arrival)).first()
        folder = new_folder(self.spark, slot)
        # A micro-batch is read by as many tasks as it has files.
        files = max(FILES_PER_BATCH, self.spark.sparkContext.defaultParallelism)
        if first is not None:
            place = F.floor((arrival - F.lit(first)) / F.lit((last - first) // MICRO_BATCHES + 1))
            for k in range(MICRO_BATCHES):
                # By hash, as dealing in turn sorts the rows first.
                part = rows.filter(place == k).repartition(files, *ids, "ts")
                part.write.mode("append").parquet(folder)
        values = {"ts": f"timestamp_ntz'{FAR_TIME}'"} | (tick or {})
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        far = [f"CAST({values.get(n, 'NULL')} AS {kind}) AS {n}" for n, kind in kinds.items()]
        self.spark.range(1).selectExpr(*far).write.mode("append").parquet(folder)
        return runner.read_stream(self.spark, folder, rows.schema, files)

    def connection_log(self) -> DataFrame:
        """What the live connections wrote."""
        events = self.stream_out_of_order(
            "connection_events",
            lambda: live_chat.connection_events(self.chat_conns),
            ["conn_id", "kind"],
            {"kind": "'tick'"},
        )
        written = self.run_stream(
            "connection-stream",
            lambda out, state: live_chat.stream_connections(events, out, state, DELAY),
            EVENTS_AT_ONCE,
        )
        return written.drop("batch")

    def senders(self, log: DataFrame) -> DataFrame:
        """Live frames with their senders."""
        frames = self.stream_out_of_order("chat_frames", lambda: self.chat_frames, ["frame_id"])
        held = self.stream_out_of_order(
            "connection_log", lambda: log, ["conn_id", "kind"], {"kind": "'tick'"}
        )
        return self.run_stream(
            "sender-stream",
            lambda out, state: live_chat.stream_senders(frames, held, out, state, DELAY, LONGEST),
        )

    def run_stream(
        self, name: str, start: Callable[[str, str], StreamingQuery], rows_at_once: int | None = None
    ) -> DataFrame:
        """Run a stream over all that is there and read what it wrote."""
        folder = new_folder(self.spark, name)
        with runner.state_partitions(self.spark, rows_at_once=rows_at_once):
            runner.finish(start(f"{folder}/out", f"{folder}/checkpoint"))
        return self.spark.read.parquet(f"{folder}/out")

    def base(self, name: str) -> DataFrame:
        return base_table(self.spark, self.sf_dir, name)

    def sql(self, query: str) -> DataFrame:
        used = {name: getattr(self, name) for name in VIEWS if reads(query, name)}
        return run(self.spark, self.sf_dir, query, tables=used)

    @property
    def bucketed_clicks(self) -> DataFrame | Buckets:
        """Clicks in buckets of the code, stored once per session; without a work folder
        the clicks as they are."""
        if work_folder(self.spark) is None:
            return self.clicks
        slot = (self.spark.sparkContext.applicationId, self.sf_dir)
        if slot not in _BUCKETED:
            folder = new_folder(self.spark, "clicks-by-code")
            name = f"clicks_{folder[-32:]}"
            Buckets(self.spark, name, "shorturl").write(self.clicks, folder, CLICK_BUCKETS)
            _BUCKETED[slot] = name
        return Buckets(self.spark, _BUCKETED[slot], "shorturl")

    @property
    def words(self) -> DataFrame:
        return text.clean_words(self.filter_lines)

    @property
    def admissions(self) -> DataFrame:
        return self.stored("admissions", self._admitted)

    def _admitted(self) -> DataFrame:
        checked = self.stored("checked_conns", lambda: chat.check_join(self.chat_conns))
        return chat.admit(self.chat_conns, checked=checked)

    def added(self) -> tuple[DataFrame, DataFrame]:
        return links.add_links(
            self.add_requests, self.users, self.shorturls, self.words, code_salt=CODE_SALT
        )

    def removed(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return links.remove_links(self.remove_requests, self.shorturls, self.clicks)

    def unlocked(self) -> DataFrame:
        return clicks.unlock_outcomes(self.unlock_attempts, self.shorturls, self.clicks)


def query(build: Callable[[_Views], DataFrame]) -> Callable[[_Views], DataFrame]:
    """Register a query under its function name."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(_Views(spark, sf_dir))
    return build


# Sources and sinks


@query
def scan_users(v):
    return v.users


@query
def scan_links(v):
    return v.shorturls


@query
def scan_clicks(v):
    return v.clicks


@query
def filter_words(v):
    lines = v.base("part").select(
        F.when(F.col("p_partkey") % 5 == 0, F.lit(" \t "))
        .otherwise(F.concat(F.lit("\t "), F.upper("p_name"), F.lit(" \r")))
        .alias("value")
    )
    return text.clean_words(lines)


@query
def parse_requests(v):
    raw = v.add_requests.select(
        "request_id",
        F.when(F.col("request_id") % 9 == 0, F.lit("{oops"))
        .otherwise(F.to_json(F.struct("redirecturl", "customshorturlcode", "password")))
        .alias("body"),
    )
    return text.parse_requests(raw, schemas.ADD_LINK_BODY)


def _access_lines(v) -> DataFrame:
    line = F.concat(
        F.col("ip"),
        F.lit(" - - ["),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(' +0000] "'),
        F.col("method"),
        F.lit(" "),
        F.col("path"),
        F.lit(' HTTP/1.1" '),
        F.col("status").cast("string"),
        F.lit(" "),
        F.col("bytes").cast("string"),
        F.lit(' "-" "agent/1.0"'),
    )
    broken = F.concat(F.lit("broken "), F.col("request_id").cast("string"))
    no_time = F.concat(
        F.lit('10.0.0.1 - - [99/Foo/2024:00:00:00 +0000] "GET /'),
        F.col("request_id").cast("string"),
        F.lit(' HTTP/1.1" 200 5 "-" "agent/1.0"'),
    )
    return v.http_requests.select(
        F.when(F.col("request_id") % 17 == 0, broken)
        .when(F.col("request_id") % 19 == 0, no_time)
        .otherwise(line)
        .alias("value")
    )


@query
def parse_access_log(v):
    return text.parse_access_log(_access_lines(v))[0]


@query
def access_log_rejects(v):
    return text.parse_access_log(_access_lines(v))[1]


@query
def append_links(v):
    # Judged once: the ids are given to stored rows.
    new = v.stored("added", lambda: v.added()[1])
    return tables.append_rows(v.shorturls, new, "request_id")


@query
def message_frames(v):
    return text.message_frames(chat.sent_messages(v.chat_frames, v.admissions))


@query
def user_list_frames(v):
    return text.user_list_frames(chat.presence(v.admissions))


@query
def listed_link_json(v):
    return text.to_frames(links.list_links(v.shorturls, v.list_requests))


# Links


@query
def add_links(v):
    return v.added()[0]


@query
def added_links(v):
    return v.added()[1]


@query
def resolve_owner(v):
    return links.resolve_owner(v.add_requests.select("request_id", "token"), v.users)


@query
def code_conflicts(v):
    asked = v.add_requests.select("request_id", F.col("customshorturlcode").alias("shorturl"))
    return links.code_conflicts(asked, v.shorturls)


@query
def remove_links(v):
    return v.removed()[0]


@query
def links_after_removal(v):
    return v.removed()[1]


@query
def clicks_after_removal(v):
    return links.remove_links(v.remove_requests, v.shorturls, v.bucketed_clicks)[2]


@query
def list_links(v):
    return links.list_links(v.shorturls, v.list_requests)


@query
def list_outcomes(v):
    return links.list_outcomes(v.list_requests, v.shorturls)


@query
def number_links(v):
    return links.number_links(v.shorturls).select("token", "id", "shorturl", "seq")


@query
def link_report(v):
    return links.link_report(links.list_links(v.shorturls, v.users), HOST)


@query
def generated_codes(v):
    owners = links.resolve_owner(v.add_requests.select("request_id", "token"), v.users)
    code = rules.generate_code(F.col("owner_id"), F.col("request_id"), CODE_SALT)
    return owners.select("request_id", code.alias("code"))


@query
def session_tokens(v):
    drawn = v.stored("tokens", lambda: v.users.select("id", rules.generate_token().alias("token")))
    owners = drawn.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("owners"))
    return drawn.join(owners, "token").select(
        "id",
        F.length("token").alias("length"),
        F.col("token").rlike(r"\A[0-9a-f]+\z").alias("hex"),
        "owners",
    )


@query
def valid_codes(v):
    code = F.col("customshorturlcode")
    return v.add_requests.select("request_id", rules.valid_code(code).alias("valid"))


@query
def flag_filtered(v):
    asked = v.add_requests.select("request_id", "customshorturlcode")
    return links.flag_filtered(asked, "customshorturlcode", v.words)


# Clicks


@query
def resolve_hits(v):
    return clicks.resolve_hits(v.link_hits, v.shorturls).select(
        "id", "shorturl", "outcome", "location"
    )


@query
def enrich_geo(v):
    hits = v.link_hits.select("id", F.col("remote_addr").alias("ip"))
    return clicks.enrich_geo(hits, v.geo)


@query
def build_clicks(v):
    return clicks.build_clicks(v.link_hits, v.shorturls, v.geo)


@query
def build_located_clicks(v):
    return clicks.build_clicks(v.link_hits, v.shorturls, v.geo, "inner")


@query
def clicks_for(v):
    return clicks.clicks_for(v.bucketed_clicks, v.click_requests)


@query
def clicks_between(v):
    """The clicks of a week, ten days after the first one, from the table kept by day."""
    folder, schema = v.stored_by_day("clicks")
    start = v.clicks.agg(F.date_trunc("day", F.min("timestamp")) + F.expr("INTERVAL 10 DAYS")).first()[0]
    start = start or datetime(1970, 1, 1)
    return tables.read_days(v.spark, folder, schema, start, start + timedelta(days=7))


@query
def analytics_outcome(v):
    requests = v.sql(
        "SELECT id AS request_id, CASE WHEN id % 50 = 7 THEN '' ELSE shorturl END AS shorturl"
        " FROM link_hits UNION ALL SELECT -id - 1 AS request_id, shorturl FROM shorturls"
    )
    return clicks.analytics_outcome(requests, v.bucketed_clicks, v.shorturls)


@query
def click_totals(v):
    return clicks.click_totals(
        v.shorturls, clicks.build_clicks(v.link_hits, v.shorturls, v.geo)
    )


@query
def click_report(v):
    return clicks.click_report(v.clicks)


@query
def unlock_outcomes(v):
    return v.unlocked()


@query
def apply_unlocks(v):
    return clicks.apply_unlocks(v.clicks, v.unlocked())


@query
def apply_unlocks_strict(v):
    return clicks.apply_unlocks(v.clicks, v.unlocked(), strict=True)


@query
def unlock_effect(v):
    return clicks.unlock_effect(v.unlocked())


# Accounts


@query
def check_signup_form(v):
    return accounts.check_signup_form(v.signup_requests).select("request_id", "problem")


@query
def register_accounts(v):
    return accounts.register(v.signup_requests, v.users)[0]


@query
def new_accounts(v):
    return accounts.register(v.signup_requests, v.users)[1].drop("token")


# Rate limit and traffic


def _limited(requests: DataFrame) -> DataFrame:
    """Requests that reach the rate limit."""
    return requests.filter(traffic.reaches_limiter(F.col("path")))


@query
def rate_limit_tumbling(v):
    limited = traffic.rate_limit_tumbling(_limited(v.http_requests), **LIMIT)
    return limited.select("request_id", "ip", "limited")


@query
def rate_limit_windows(v):
    return traffic.window_counts(_limited(v.http_requests), **LIMIT)


@query
def rate_limit_default(v):
    limited = traffic.rate_limit_tumbling(_limited(v.busy_requests))
    return limited.select("request_id", "ip", "limited")


@query
def rate_limit_anchored(v):
    limited = traffic.rate_limit_anchored(_limited(v.http_requests), **LIMIT)
    return limited.select("request_id", "ip", "limited")


@query
def classify_route(v):
    return traffic.classify_route(v.http_requests).select("request_id", "route")


@query
def classify_probe(v):
    return traffic.classify_probe(v.url_probes).select("probe_id", "outcome")


# Chat


@query
def check_join(v):
    return chat.check_join(v.chat_conns).select("conn_id", "username", "error")


@query
def admit(v):
    return chat.admit(v.chat_conns).select("conn_id", "username", "admitted", "error")


@query
def presence(v):
    lists = chat.presence(v.admissions)
    return lists.withColumn("users", F.array_join("users", ","))


@query
def online_counts(v):
    return chat.online_counts(v.admissions)


@query
def presence_log(v):
    return chat.presence_log(v.admissions, PRESENCE_PAGE)


@query
def presence_from_log(v):
    """The lists of `presence`, each from one page of the log."""
    log = v.stored("presence-log", lambda: chat.presence_log(v.admissions, PRESENCE_PAGE))
    return chat.lists_of_log(log).withColumn("users", F.array_join("users", ","))


@query
def check_frame(v):
    return chat.check_frame(v.chat_frames).select("frame_id", "status", "message")


@query
def fan_out(v):
    return chat.fan_out(v.chat_frames, v.admissions)


@query
def fan_out_versions(v):
    return chat.fan_out_versions(v.chat_frames, v.admissions)


@query
def delivery_counts(v):
    return chat.delivery_counts(v.chat_frames, v.admissions)


# Scalar rules


@query
def normalize_url(v):
    target = F.col("redirecturl")
    return v.shorturls.select("id", rules.normalize_url(target).alias("url"))


@query
def extract_code(v):
    shown = F.concat(F.lit("see "), F.lit(HOST), F.col("path"), F.lit(" end"))
    code = rules.extract_code(shown, HOST)
    return v.http_requests.select("request_id", code.alias("code"))


@query
def js_trim(v):
    padded = F.concat(F.lit("\u00a0\t"), F.col("p_name"), F.lit("\u3000\ufeff\n"))
    return v.base("part").select("p_partkey", rules.js_trim(padded).alias("trimmed"))


@query
def decode_uri_component(v):
    decoded = rules.decode_uri_component(F.col("url_param"))
    return v.url_probes.select("probe_id", decoded.alias("decoded"))


@query
def query_fields(v):
    path = F.col("path")
    return v.http_requests.select(
        "request_id",
        rules.query_tail(path).alias("tail"),
        rules.query_param(path, "aid").alias("aid"),
        rules.query_param(path, "url").alias("url"),
    )


@query
def last_segment(v):
    segment = rules.last_segment(rules.path_only(F.col("path")))
    return v.http_requests.select("request_id", segment.alias("segment"))


@query
def client_ip(v):
    ip = rules.first_present(F.col("xff"), F.col("remote_addr"))
    return v.link_hits.select("id", rules.present(F.col("xff")).alias("forwarded"), ip.alias("ip"))


@query
def utc_second(v):
    return v.link_hits.select(
        "id",
        rules.utc_second(F.col("ts")).alias("second"),
        rules.utc_second_text(F.col("ts")).alias("second_text"),
    )


@query
def payload_types(v):
    return payloads.classify_payloads(v.qr_payloads).select("payload_id", "type")


@query
def payload_type_counts(v):
    return payloads.payload_type_counts(v.qr_payloads)


@query
def payload_fields(v):
    found = payloads.classify_payloads(v.qr_payloads)
    pairs = F.transform("fields", lambda e: F.concat(e["name"], F.lit("="), e["value"]))
    return found.select(
        "payload_id", "type", F.array_join(F.array_sort(pairs), "|").alias("fields")
    )


# Streams


@query
def stream_clicks(v):
    return v.run_stream(
        "clicks-stream",
        lambda out, state: live_clicks.stream_clicks(
            v.stream("link_hits"), lambda: v.shorturls, lambda: v.geo, out, state
        ),
    ).drop("batch")


@query
def stream_click_totals(v):
    written = v.run_stream(
        "totals-stream",
        lambda out, state: live_clicks.stream_click_totals(v.stream("clicks"), out, state),
    )
    return live_clicks.latest_totals(written)


@query
def stream_rate_limit(v):
    written = v.run_stream(
        "limit-stream",
        lambda out, state: live_traffic.stream_rate_limit(
            _limited(v.stream_in_time("http_requests", lambda: v.http_requests)),
            out,
            state,
            window_seconds=LIMIT["window_seconds"],
        ),
    )
    return live_traffic.latest_windows(written, max_hits=LIMIT["max_hits"])


@query
def stream_rate_limit_anchored(v):
    requests = v.stream_out_of_order("reached", lambda: _limited(v.http_requests), ["request_id"])
    written = v.run_stream(
        "anchored-stream",
        lambda out, checkpoint: live_traffic.stream_rate_limit_anchored(
            requests, out, checkpoint, delay=DELAY, **LIMIT
        ),
        EVENTS_AT_ONCE,
    )
    return written.select("request_id", "ip", "limited")


@query
def stream_unlocks(v):
    kept = Snapshot(v.spark, new_folder(v.spark, "click-snapshot"), v.clicks.schema, CLICK_RANGE)
    kept.write(v.clicks, 0)
    v.run_stream(
        "unlock-stream",
        lambda out, state: live_clicks.stream_unlocks_into(
            v.stream("unlock_attempts"), lambda: v.shorturls, kept, out, state
        ),
    )
    return kept.read()


@query
def stream_admissions(v):
    found = live_chat.admissions_of(v.connection_log())
    return found.select("conn_id", "username", "admitted", "error")


@query
def stream_presence(v):
    return live_chat.lists_of(v.connection_log()).withColumn("users", F.array_join("users", ","))


@query
def stream_fan_out(v):
    log = v.connection_log()
    return live_chat.fan_out_of(v.senders(log), log)


@query
def stream_delivery_counts(v):
    log = v.connection_log()
    return live_chat.delivery_counts_of(v.senders(log), log)


@query
def stream_senders(v):
    """Every accepted frame, with its sender or without."""
    return v.senders(v.connection_log()).select("frame_id", "username")


@query
def stream_first_username(v):
    requests = accounts.complete_requests(v.stream("signup_requests"))
    written = v.run_stream(
        "username-stream",
        lambda out, state: live_traffic.stream_first_writer(
            requests, "username", lambda: v.users, out, state
        ),
    )
    return live_traffic.first_writers(written, "username")


@query
def stream_first_code(v):
    def ask(rows: DataFrame) -> DataFrame:
        judged = links.judge_adds(rows, v.users, v.words, code_salt=CODE_SALT)
        return judged.filter("_failed IS NULL").select(
            "request_id", F.col("_code").alias("shorturl")
        )

    written = v.run_stream(
        "code-stream",
        lambda out, state: live_traffic.stream_first_writer(
            v.stream("add_requests"), "shorturl", lambda: v.shorturls, out, state, ask
        ),
    )
    chosen = v.add_requests.filter("customshorturlcode <> ''").select("request_id")
    return live_traffic.first_writers(written, "shorturl").join(chosen, "request_id", "left_semi")


def stored_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Store fixture views, and the clicks by code, ahead of the queries that read them."""
    views = _Views(spark, sf_dir)
    for name in [*names, "bucketed_clicks"]:
        getattr(views, name)
