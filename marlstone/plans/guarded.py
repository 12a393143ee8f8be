"""Ad-hoc SQL that may only read, with personal data masked by where a column comes from."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import text
from marlstone.plans.provenance import Provenance
from marlstone.session import shared_dir
from marlstone.sources.bindings import LOGICAL, Catalog

#: Rows that a tool gets at most, and seconds that a role's statement may take.
ROW_CAP = 200
TIMEOUTS = {"tools": 10.0, "metrics": 30.0}
#: Functions that statements may call; none reads files, settings or classes.
FUNCTIONS = frozenset(
    "count sum avg mean min max stddev variance median first last any_value bool_and bool_or every some count_if collect_list collect_set array_agg approx_count_distinct percentile percentile_approx corr "
    "row_number rank dense_rank ntile lag lead first_value last_value nth_value cume_dist percent_rank "
    "abs ceil ceiling floor round bround sqrt power pow exp ln log log10 log2 mod pmod sign signum greatest least rand "
    "coalesce nullif ifnull nvl nvl2 if isnull isnotnull cast try_cast double int bigint string boolean decimal date timestamp "
    "lower upper trim ltrim rtrim btrim length char_length concat concat_ws substring substr left right replace translate reverse repeat lpad rpad split initcap instr position locate contains startswith endswith regexp_replace regexp_extract regexp_extract_all regexp_like rlike like ilike format_number md5 sha1 sha2 "
    "year quarter month day dayofmonth dayofweek hour minute second date_trunc trunc date_add date_sub datediff months_between add_months last_day to_date to_timestamp date_format current_date current_timestamp now unix_timestamp "
    "array map struct named_struct size array_contains array_distinct array_sort sort_array element_at explode posexplode inline transform filter aggregate exists flatten slice sequence to_json get_json_object from_json grouping grouping_id".split()
)
_WRITES = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
_LEAVES = frozenset({"UnresolvedRelation", "OneRowRelation", "UnresolvedInlineTable", "LocalRelation"})


class Rejected(ValueError):
    pass


class TimedOut(TimeoutError):
    pass


@dataclass
class Answer:
    rows: DataFrame
    truncated: bool
    path: str | None = None

    def drop(self) -> None:
        """Remove the table of an answer that has one; its rows can't be read after."""
        if self.path:
            spark = self.rows.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _plans(plan) -> Iterator:
    """A parsed plan's nodes, those of subqueries and common tables too."""
    yield plan
    for kin in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for p in _each(kin):
            yield from _plans(p)


def _expressions(expression) -> Iterator:
    yield expression
    for e in _each(expression.children()):
        yield from _expressions(e)


def check(catalog: Catalog, sql: str) -> list[str]:
    """The logical tables that a statement reads; raises Rejected unless it is one reading statement over them alone.

    Its words are tested first, then the plan that Catalyst parses: no commands, no relation but
    logical tables and the statement's own common tables, no table functions, no function but FUNCTIONS.
    """
    spark = catalog.spark
    if not spark.createDataFrame([(sql,)], "q string").select(text.read_only(F.col("q"))).first()[0]:
        raise Rejected("only one statement that reads is allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    loader = spark._jvm.java.lang.Class
    if any(loader.forName(name).isInstance(plan) for name in _WRITES):
        raise Rejected("only queries are allowed")
    used, own = set(), set()
    for node in _plans(plan):
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            own |= {t._1().lower() for t in _each(node.cteRelations())}
        if kind == "UnresolvedRelation":
            used.add(".".join(_each(node.multipartIdentifier())).lower())
        elif not node.children().size() and kind not in _LEAVES:
            raise Rejected(f"{kind} is not allowed")
        for top in _each(node.expressions()):
            for e in _expressions(top):
                kind = e.getClass().getSimpleName()
                if kind == "UnresolvedFunction" and ".".join(_each(e.nameParts())).lower() not in FUNCTIONS:
                    raise Rejected(f"function {'.'.join(_each(e.nameParts()))} is not allowed")
                if kind == "UnresolvedGenerator" and e.name().unquotedString().lower() not in FUNCTIONS:
                    raise Rejected(f"function {e.name().unquotedString()} is not allowed")
                if kind == "ExpressionWithUnresolvedIdentifier":
                    raise Rejected("computed names are not allowed")
    unknown = sorted(used - own - set(LOGICAL))
    if unknown:
        raise Rejected(f"unknown tables: {', '.join(unknown)}")
    return sorted(used & set(LOGICAL))


def personal(names: Iterable[str], restricted: Iterable[str] = ()) -> bool:
    """Whether a name among these is that of personal data, or restricted."""
    return any(p in n.lower() for n in names for p in (*text.SPECIAL_COLUMNS, *text.PERSONAL_COLUMNS)) or any(n.lower() in restricted for n in names)


def masked(df: DataFrame, restricted: Iterable[str] = (), origin: Provenance | None = None) -> DataFrame:
    """df with columns that come from personal data, or from restricted columns, replaced by a mark (nulls stay null), whatever they are called."""
    restricted, origin = set(restricted), origin or Provenance(df)
    hide = [personal({*names, c}, restricted) for c, names in zip(df.columns, origin.columns())]
    apart = df.toDF(*[f"c{i}" for i in range(len(hide))])  # two columns may bear one name
    return apart.select(*[(F.when(F.col(f"c{i}").isNotNull(), F.lit("[REDACTED]")) if hidden else F.col(f"c{i}")).alias(name) for i, (hidden, name) in enumerate(zip(hide, df.columns))])


def within(spark: SparkSession, seconds: float | None, run: Callable):
    """run(), whose Spark jobs are cancelled after so many seconds, those that it has yet to start too; then TimedOut is raised."""
    if seconds is None:
        return run()
    group, late = f"marlstone-{uuid.uuid4().hex}", threading.Event()
    sc = spark.sparkContext

    def stop() -> None:
        late.set()
        sc._jsc.sc().cancelJobGroupAndFutureJobs(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "a statement with a time limit", interruptOnCancel=True)
    timer.start()
    try:
        return run()
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"stopped after {seconds:g} seconds") from e
        raise
    finally:
        timer.cancel()
        sc._jsc.clearJobGroup()


def _kept(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """df's rows, written and read back; neither two columns of one name nor a column of nulls alone can be stored as they are."""
    names, kinds = df.columns, [f.dataType for f in df.schema.fields]
    apart = df.toDF(*[f"c{i}" for i in range(len(names))])
    apart.select(*[F.col(c).cast("string") if isinstance(k, T.NullType) else F.col(c) for c, k in zip(apart.columns, kinds)]).write.parquet(path)
    return spark.read.parquet(path).toDF(*names)


def query(catalog: Catalog, sql: str, cap: int | None = ROW_CAP, seconds: float | None = None) -> Answer:
    """At most cap rows (None: all) of a reading statement over the logical tables, and whether there are more.

    The tables are views of a session of its own, so a caller's views are neither seen nor touched;
    they show what the catalog's role may see. Columns made from personal data are masked, however
    they got there, and a statement that chooses, matches or orders rows by personal data is
    refused: its rows would tell what the mask hides. (Asking whether a value is there is allowed.)

    The statement runs once, within its role's time (or so many seconds): what is returned are rows
    that were gathered, or with cap=None written to the shared folder, where they stay until drop().
    """
    used = check(catalog, sql)
    spark = catalog.spark
    apart = Catalog(spark.newSession(), catalog.sf_dir, catalog.role)
    for t in used:
        apart.table(t).createOrReplaceTempView(t)
    df = apart.spark.sql(sql.strip().rstrip(";"))
    origin = Provenance(df)
    if personal(origin.conditions()):
        raise Rejected("rows can't be chosen, matched or ordered by personal data")
    df, limit = masked(df, origin=origin), seconds or TIMEOUTS.get(catalog.role)
    if cap is None:
        path = f"{shared_dir(spark)}/answer-{uuid.uuid4().hex}"
        return Answer(within(spark, limit, lambda: _kept(spark, df, path)), False, path)
    rows = within(spark, limit, lambda: df.limit(cap + 1).collect())
    return Answer(spark.createDataFrame([tuple(r) for r in rows[:cap]], df.schema), len(rows) > cap)


def scalar_text(catalog: Catalog, sql: str) -> str:
    """The first row of a statement, its values joined by '|'; empty if there is none."""
    row = query(catalog, sql, 1).rows.first()
    return "" if row is None else "|".join("" if v is None else str(v) for v in row)
