"""What the engine knows of a set of tables: columns, kinds, keys and intervals."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

DISCRETE, CONTINUOUS = "DISCRETE", "CONTINUOUS"

# The interval presets (timestamps in microseconds), and the tables below.
_MINUTE = 60_000_000
TIME_INTERVALS = tuple(_MINUTE * m for m in (1, 5, 10, 30, 60, 120, 240, 720, 1440, 10080, 20160, 40320, 524160))
POWER_INTERVALS = tuple(2**k for k in range(11))
YEAR_INTERVALS = (1, 2, 4, 8, 16, 32)


@dataclass(frozen=True)
class Column:
    """kind: int, double, string or timestamp; role: DISCRETE or CONTINUOUS (for dependence features)."""

    kind: str
    role: str = DISCRETE
    intervals: tuple[int, ...] = ()


@dataclass(frozen=True)
class Table:
    name: str
    columns: dict[str, Column] = field(hash=False)
    keys: tuple[str, ...] = ()
    primary: tuple[str, ...] = ()
    #: All fields of a file without a header, in order; None: the file has one.
    fields: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        unknown = (set(self.keys) | set(self.primary)) - set(self.columns)
        if unknown:
            raise ValueError(f"{self.name} has no {sorted(unknown)}")

    @property
    def dates(self) -> tuple[str, ...]:
        return tuple(c for c, x in self.columns.items() if x.kind == "timestamp")


@dataclass(frozen=True)
class Dataset:
    name: str
    tables: dict[str, Table] = field(hash=False)

    def column(self, table: str, column: str) -> Column:
        try:
            return self.tables[table].columns[column]
        except KeyError:
            raise ValueError(f"{self.name} has no column {table}.{column}") from None

    def with_table(self, table: Table) -> Dataset:
        return replace(self, tables={**self.tables, table.name: table})


def _int(role: str = DISCRETE, intervals: tuple[int, ...] = ()) -> Column:
    return Column("int", role, intervals)


_KEY, _TIME, _POWER = _int(), Column("timestamp", CONTINUOUS, TIME_INTERVALS), _int(CONTINUOUS, POWER_INTERVALS)


def stats_ceb() -> Dataset:
    def table(name: str, keys: str, **columns: Column) -> Table:
        return Table(name, {"Id": _KEY, **columns}, tuple(keys.split()), ("Id",))

    return Dataset("stats-ceb", {t.name: t for t in (
        table("badges", "UserId", UserId=_KEY, Date=_TIME),
        table("comments", "UserId PostId", PostId=_KEY, Score=_POWER, CreationDate=_TIME, UserId=_KEY),
        table("postHistory", "UserId PostId", PostHistoryTypeId=_KEY, PostId=_KEY, CreationDate=_TIME, UserId=_KEY),
        table("postLinks", "RelatedPostId PostId", CreationDate=_TIME, PostId=_KEY, RelatedPostId=_KEY, LinkTypeId=_KEY),
        table("posts", "OwnerUserId Id", PostTypeId=_KEY, CreationDate=_TIME, Score=_POWER, ViewCount=_POWER, OwnerUserId=_KEY, AnswerCount=_POWER, CommentCount=_POWER, FavoriteCount=_POWER, LastEditorUserId=_KEY),
        table("tags", "ExcerptPostId", Count=_POWER, ExcerptPostId=_int(CONTINUOUS)),
        table("users", "Id", Reputation=_POWER, CreationDate=_TIME, Views=_POWER, UpVotes=_POWER, DownVotes=_POWER),
        table("votes", "UserId PostId", PostId=_KEY, VoteTypeId=_KEY, CreationDate=_TIME, UserId=_KEY, BountyAmount=_POWER),
    )})


def job_light() -> Dataset:
    def table(name: str, fields: str, key: str, **columns: Column) -> Table:
        return Table(name, columns, (key,), (key,) if key == "id" else (), tuple(fields.split()))

    return Dataset("job-light", {t.name: t for t in (
        table("title", "id title imdb_index kind_id production_year imdb_id phonetic_code episode_of_id season_nr episode_nr series_years md5sum", "id", id=_KEY, kind_id=_KEY, production_year=_int(CONTINUOUS, YEAR_INTERVALS)),
        table("movie_info", "id movie_id info_type_id info note", "movie_id", info_type_id=_KEY, movie_id=_KEY),
        table("movie_companies", "id movie_id company_id company_type_id note", "movie_id", company_type_id=_KEY, company_id=_KEY, movie_id=_KEY),
        table("movie_info_idx", "id movie_id info_type_id info note", "movie_id", info_type_id=_KEY, movie_id=_KEY),
        table("movie_keyword", "id movie_id keyword_id", "movie_id", keyword_id=_KEY, movie_id=_KEY),
        table("cast_info", "id person_id movie_id person_role_id note nr_order role_id", "movie_id", role_id=_KEY, movie_id=_KEY),
    )})


def retail() -> Dataset:
    """The star schema of the test tables."""
    def money(*intervals: int) -> Column:
        return Column("double", CONTINUOUS, intervals)

    text, small = Column("string"), _int(CONTINUOUS, YEAR_INTERVALS)
    return Dataset("retail", {t.name: t for t in (
        Table("lineitem", {"l_orderkey": _KEY, "l_partkey": _KEY, "l_suppkey": _KEY, "l_linenumber": _KEY, "l_quantity": money(*YEAR_INTERVALS), "l_extendedprice": money(*(64 * p for p in POWER_INTERVALS)), "l_returnflag": text, "l_shipdate": _TIME}, ("l_orderkey", "l_partkey", "l_suppkey")),
        Table("orders", {"o_orderkey": _KEY, "o_custkey": _KEY, "o_orderstatus": text, "o_totalprice": money(*(64 * p for p in POWER_INTERVALS)), "o_orderdate": _TIME, "o_orderpriority": text}, ("o_orderkey", "o_custkey"), ("o_orderkey",)),
        Table("customer", {"c_custkey": _KEY, "c_nationkey": _KEY, "c_acctbal": money(*POWER_INTERVALS), "c_mktsegment": text}, ("c_custkey", "c_nationkey"), ("c_custkey",)),
        Table("supplier", {"s_suppkey": _KEY, "s_nationkey": _KEY, "s_acctbal": money(*POWER_INTERVALS)}, ("s_suppkey", "s_nationkey"), ("s_suppkey",)),
        Table("part", {"p_partkey": _KEY, "p_name": text, "p_brand": text, "p_type": text, "p_size": small}, ("p_partkey",), ("p_partkey",)),
        Table("nation", {"n_nationkey": _KEY, "n_name": text, "n_regionkey": _KEY}, ("n_nationkey", "n_regionkey"), ("n_nationkey",)),
        Table("region", {"r_regionkey": _KEY, "r_name": text}, ("r_regionkey",), ("r_regionkey",)),
        Table("events", {"event_id": _KEY, "user_id": _KEY, "ts": _TIME, "event_type": text, "value": money(*YEAR_INTERVALS)}, ("user_id",), ("event_id",)),
    )})


DATASETS = {"stats-ceb": stats_ceb, "job-light": job_light, "retail": retail}
