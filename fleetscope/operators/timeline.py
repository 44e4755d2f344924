"""Activity of processes over time, and chains of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.operators.pointers import follow, parents
from fleetscope.sources.checkpoints import checkpointed


def activity_history(events: DataFrame, cap: int = 500, by: Sequence[str] = ("host_id",), actor: str = "process_pid", parent: str = "parent_pid", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """``pid, role`` and the event: what each process did, or its child, the newest ``cap``. Two equi-sides instead of an OR."""
    own = events.where(F.col(actor).isNotNull()).withColumn("pid", F.col(actor)).withColumn("role", F.lit("own"))
    child = events.where(F.col(parent).isNotNull() & ~F.col(parent).eqNullSafe(F.col(actor))).withColumn("pid", F.col(parent)).withColumn("role", F.lit("child"))
    rank = F.row_number().over(Window.partitionBy(*by, "pid").orderBy(*(F.desc(c) for c in order)))
    return own.unionByName(child).withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")


def activity_told(history: DataFrame) -> DataFrame:
    """``kind, target, child_pid`` of each row of a history: what was done and to what, and which process a command became."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in history.columns else F.lit("")
    first = lambda *names: F.coalesce(*(F.nullif(text(c), F.lit("")) for c in names), F.lit(""))
    began, own, category = text("event_action") == "process_started", F.col("role") == "own", text("event_category")
    kind = F.when(began & own, "started").when(began, "launched").when(category == "network", "network").when(category == "file", "file").when(category == "authentication", "auth").otherwise(F.coalesce(F.nullif(category, F.lit("")), F.lit("event")))
    address = F.when(text("destination_ip") != "", F.concat_ws(":", text("destination_ip"), F.nullif(text("destination_port"), F.lit("")))).otherwise(text("object_name"))
    network = F.concat(address, F.when(text("destination_as_org") != "", F.concat(F.lit("  ("), text("destination_as_org"), F.lit(")"))).otherwise(""))
    started = ("process_command_line", "process_executable", "process_name")
    target = F.when(began & own, first(*started)).when(began, first(*started, "message")).when(category == "network", network).when(category == "file", first("file_path", "object_name")).otherwise(first("object_name", "message"))
    return history.withColumn("kind", kind).withColumn("target", F.substring(target, 1, 140)).withColumn("child_pid", F.when(began & ~own, text("process_pid")).otherwise(""))


#: What a section's line begins with; other kinds begin with their own name.
VERBS = {"started": "started", "launched": "launched", "network": "→", "file": "changed", "auth": "auth", "event": ""}


def by_day(history: DataFrame, by: Sequence[str] = ("host_id", "pid"), ts: str = "ts", cap: int = 500) -> DataFrame:
    """``day, n, first_ts, last_ts, lines`` of each process: the lines (``at``, ``told``) of a day in order of time; a day has at most ``cap`` of them, the newest."""
    told = activity_told(history)
    verb = F.coalesce(F.create_map(*(F.lit(x) for kv in VERBS.items() for x in kv))[F.col("kind")], F.col("kind"))
    line = F.trim(F.concat_ws(" ", F.nullif(verb, F.lit("")), F.nullif("target", F.lit(""))))
    message = F.coalesce(F.col("message"), F.lit("")) if "message" in history.columns else F.lit("")
    line = F.concat(F.when(line == "", message).otherwise(line), F.when(F.col("child_pid") != "", F.concat(F.lit("  [pid "), "child_pid", F.lit("]"))).otherwise(""))
    rows = told.select(*by, F.to_date(ts).alias("day"), F.col(ts).alias("_ts"), F.col("event_id").alias("_id"), line.alias("_line"))
    place = F.row_number().over(Window.partitionBy(*by, "day").orderBy(F.desc("_ts"), F.desc("_id")))
    newest = F.when(F.col("_r") <= cap, F.struct("_ts", "_id", F.date_format("_ts", "HH:mm:ss").alias("at"), F.col("_line").alias("told")))
    days = rows.withColumn("_r", place).groupBy(*by, "day").agg(F.count(F.lit(1)).alias("n"), F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts"), F.array_sort(F.collect_list(newest)).alias("_lines"))
    return days.withColumn("lines", F.transform("_lines", lambda x: F.struct(x["at"], x["told"]))).drop("_lines")


def process_detail(processes: DataFrame, closure: DataFrame, sockets: DataFrame, open_files: DataFrame, events: DataFrame, children: int = 25) -> DataFrame:
    """One row a process: ancestors, children, sockets, files, and its own package, for all processes at once."""
    keys = ["host_id", "pid"]
    up = closure.groupBy("host_id", F.col("id").alias("pid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"].cast("string")), " ← ").alias("ancestors"))
    rank = F.row_number().over(Window.partitionBy("host_id", "ppid").orderBy("pid"))
    down = processes.where("pid <> ppid").withColumn("_r", rank).where(F.col("_r") <= children).groupBy("host_id", F.col("ppid").alias("pid")).agg(F.count(F.lit(1)).alias("n_children"), F.array_join(F.array_sort(F.collect_list(F.col("pid").cast("string"))), ",").alias("children"))
    net = sockets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sockets"))
    files = open_files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"))
    seen = events.groupBy("host_id", F.col("process_pid").alias("pid")).agg(F.count(F.lit(1)).alias("n_events"))
    out = processes
    for t in (up, down, net, files, seen):
        out = out.join(t, keys, "left")
    return out.fillna(0, ["n_children", "n_sockets", "n_files", "n_events"]).fillna("", ["ancestors", "children"])


SHELLS = ("bash", "zsh", "fish", "sh", "dash", "ksh", "tcsh")


def chain_roots(edges: DataFrame, names: DataFrame, shells: Sequence[str] = SHELLS, by: Sequence[str] = ("host_id",)) -> DataFrame:
    """``by…, id, root``: each process's chain begins below an interactive shell, or below the last ancestor that is known.

    ``edges`` has ``child, parent``, ``names`` has ``id, name``. A process whose parent is a shell, or whose grandparent isn't known,
    is its own root; the others have their parent's. Depth has no bound. A walk that would go round in a cycle ends before it meets
    a process for the second time: its root is the member whose parent is the first member that it came to.
    """
    up = checkpointed(parents(edges, by))
    shell = names.where(F.substring_index("name", "/", -1).isin(list(shells))).select(*by, F.col("id").alias("to")).distinct()
    steps = up.join(shell, [*by, "to"], "left_anti").join(up.select(*by, F.col("id").alias("to")), [*by, "to"], "left_semi")
    steps = checkpointed(steps.select(*by, "id", "to"))
    walks = checkpointed(follow(steps, by))
    members = walks.where("entry = id").select(*by, "id")
    before = steps.join(members, [*by, "id"], "left_semi").select(*by, F.col("to").alias("entry"), F.col("id").alias("_before"))
    roots = walks.where("entry IS NULL").select(*by, "id", F.col("end").alias("_end"))
    roots = roots.unionByName(walks.where("entry IS NOT NULL").join(before, [*by, "entry"]).select(*by, "id", F.col("_before").alias("_end")))
    return up.select(*by, "id").join(roots, [*by, "id"], "left").select(*by, "id", F.coalesce("_end", "id").alias("root"))


TOKENS_LEFT_OUT = ("sudo", "install", "remove", "update")


def command_words(command: str) -> list[str]:
    """The words of a command line that may name an object."""
    return [w for w in (w.strip("\"'`") for w in command.split()) if len(w) > 3 and w[0] != "-" and "/" not in w and w not in TOKENS_LEFT_OUT]


class ChainState:
    """What the chains of one host have touched last: sockets, objects, users."""

    def __init__(self):
        self.sockets: dict[str, str] = {}
        self.objects: dict[str, str] = {}
        self.users: dict[str, str] = {}

    def assign(self, root: str, socket: str, thing: str, command: str, user: str, module: str) -> tuple[str, str]:
        """The event's chain and how it was found; then the event's own marks are remembered."""
        if root:
            chain, how = f"proc:{root}", "ancestry"
        elif socket in self.sockets and socket:
            chain, how = self.sockets[socket], "socket"
        elif thing in self.objects and thing:
            chain, how = self.objects[thing], "object"
        elif user in self.users and user:
            chain, how = self.users[user], "time"
        else:
            chain, how = (f"user:{user}" if user else f"mod:{module or '?'}"), "time"
        if socket:
            self.sockets[socket] = chain
        if thing:
            self.objects[thing] = chain
        for word in command_words(command):
            self.objects.setdefault(word, chain)
        if user:
            self.users[user] = chain
        return chain, how


def _previous(rows: DataFrame, keys: Sequence[str], order: str = "at", value: str = "event_id") -> DataFrame:
    """``rows`` with ``last``: the ``value`` of the row before it among those with the same ``keys``.

    The rows are cut into ranges of about equal number by key and order, so that a key with a third of them stands in many;
    rows are ordered inside a range, and a table of one row a key and range carries over what stands before it.
    """
    ranged = checkpointed(rows.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()))
    ends = ranged.groupBy(*keys, "_range").agg(F.max_by(value, order).alias("_end"))
    ends = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_range"))).drop("_end")
    inside = F.lag(value).over(Window.partitionBy(*keys, "_range").orderBy(order))
    return ranged.withColumn("_here", inside).join(ends, [*keys, "_range"]).withColumn("last", F.coalesce("_here", "_carried")).drop("_here", "_carried", "_range")


def build_chains(events: DataFrame, roots: DataFrame, by: Sequence[str] = ("host_id",)) -> DataFrame:
    """``by…, event_id, ts, chain_id, how`` of each event.

    Roots come from the process tree by a join. What has no process follows the latest
    earlier event with the same socket, else object, else user; an object is also known
    by the first command line that had it as a word. Which event that is depends on keys
    and times only: a scan of all keys' events in order finds it, and ``follow`` leads each
    event to the first of its chain. Order is ``ts``, null last, then
    ``event_id``, which is unique and not null in ``by``.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in events.columns else F.lit("")
    keyed = events.join(roots.select(*by, F.col("id").alias("process_pid"), F.col("root").cast("string").alias("_root")), [*by, "process_pid"], "left")
    user = F.when(text("subject_name") != "", F.trim(text("subject_name"))).otherwise(F.trim(text("user_name")))
    socket = F.when(text("destination_ip") != "", F.concat_ws(":", text("destination_ip"), text("destination_port"))).otherwise("")
    thing = F.when(text("file_path") != "", text("file_path")).when(text("object_name") != "", text("object_name")).otherwise(text("package_name"))
    at = F.struct(F.col("ts").isNull().alias("none"), F.col("ts").alias("ts"), F.col("event_id").alias("id"))
    own = checkpointed(keyed.select(*by, "event_id", "ts", at.alias("at"), F.coalesce("_root", text("process_pid")).alias("root"), socket.alias("socket"), thing.alias("object"), text("process_command_line").alias("command"), user.alias("user"), text("event_module").alias("module")))
    ids = [*by, "event_id"]
    marks = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("socket", "object", "user")))
    marked = own.select(*ids, "at", (F.col("root") == "").alias("loose"), F.explode(F.filter(marks, lambda x: x["key"] != "")).alias("x")).select(*ids, "at", "loose", "x.*")
    # Keys that no loose event has, lead nobody.
    asked = marked.where("loose").select(*by, "kind", "key").distinct()
    found = _previous(marked.join(asked, [*by, "kind", "key"], "left_semi"), [*by, "kind", "key"]).where("loose AND last IS NOT NULL").select(*ids, "kind", "last")
    words = F.transform(F.split("command", r"\s+"), lambda w: F.regexp_replace(w, "^[\"'`]+|[\"'`]+$", ""))
    words = F.filter(words, lambda w: (F.length(w) > 3) & ~w.startswith("-") & ~w.contains("/") & ~w.isin(list(TOKENS_LEFT_OUT)))
    said = own.where("command <> ''").select(*by, "event_id", "at", F.explode(words).alias("object")).groupBy(*by, "object").agg(F.min("at").alias("_since"), F.min_by("event_id", "at").alias("_said"))
    things = own.where("root = '' AND object <> ''").select(*ids, "object", "at").join(said, [*by, "object"]).where("_since < at").select(*ids, F.lit("said").alias("kind"), F.col("_said").alias("last"))
    found = found.unionByName(things).groupBy(*ids).agg(*(F.max(F.when(F.col("kind") == k, F.col("last"))).alias(f"_{k}") for k in ("socket", "object", "said", "user")))
    found = own.select(*ids, "ts", "root", "user", "module").join(found, ids, "left")
    how = F.when(F.col("root") != "", "ancestry").when(F.col("_socket").isNotNull(), "socket").when(F.coalesce("_object", "_said").isNotNull(), "object").otherwise("time")
    to = F.when(F.col("root") == "", F.coalesce("_socket", "_object", "_said", "_user"))
    first = F.when(F.col("root") != "", F.concat(F.lit("proc:"), "root")).when(F.col("user") != "", F.concat(F.lit("user:"), "user")).otherwise(F.concat(F.lit("mod:"), F.when(F.col("module") != "", F.col("module")).otherwise("?")))
    chains = checkpointed(found.select(*ids, "ts", how.alias("how"), first.alias("chain_id"), to.alias("_next")))
    ends = follow(chains.where("_next IS NOT NULL").select(*ids, "_next"), by, "event_id", "_next").select(*ids, "end")
    firsts = chains.where("_next IS NULL").select(*by, F.col("event_id").alias("end"), "chain_id")
    led = chains.where("_next IS NOT NULL").drop("chain_id").join(ends, ids).join(firsts, [*by, "end"])
    return chains.where("_next IS NULL").select(*ids, "ts", "chain_id", "how").unionByName(led.select(*ids, "ts", "chain_id", "how"))


#: Fixed order in which a chain's categories are named; others follow by name.
CATEGORY_ORDER = ("process", "authentication", "file", "network", "package", "iam", "intrusion_detection")
#: How far each kind of link can be trusted.
LINK_STRENGTH = {"ancestry": "strong", "socket": "strong", "object": "medium", "time": "weak"}


def chain_summary(chains: DataFrame, events: DataFrame, names: DataFrame | None = None, by: Sequence[str] = ("host_id",), min_len: int = 2, top: int = 4, users: int = 3) -> DataFrame:
    """One row a chain of at least ``min_len`` events: title, times, counts by category and kind of link, what it did most, where it went, who took part.

    ``span`` is the number of categories; chains of many, then the severe, then the long come first. The title is the root process's
    name (``names``: ``id, name``), else the command or process of the first event. Values of equal count stand in order of appearance.
    """
    keys = [*by, "chain_id"]
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) if c in events.columns else F.lit("")
    seen = events.select(
        *by, "event_id", text("process_pid").alias("pid"), text("event_category").alias("category"), text("event_action").alias("action"), text("destination_ip").alias("destination"),
        F.when(text("subject_name") != "", text("subject_name")).otherwise(text("user_name")).alias("user"), F.coalesce(F.col("event_severity").cast("long"), F.lit(0)).alias("severity"),
        F.element_at(F.split(F.split_part(text("process_command_line"), F.lit(" "), F.lit(1)), "/"), -1).alias("command"), text("process_name").alias("name"),
    )
    at = F.struct(F.col("ts").isNull().alias("none"), F.col("ts").alias("ts"), F.col("event_id").alias("id"))
    rows = checkpointed(chains.select(*by, "event_id", "chain_id", "how", "ts", at.alias("at")).join(seen, [*by, "event_id"]))
    first = F.min_by(F.struct("how", "command", "name"), "at").alias("_first")
    main = rows.groupBy(*keys).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"), F.max("severity").alias("severity"), first, *(F.count_if(F.col("how") == h).alias(f"n_{h}") for h in LINK_STRENGTH)).where(F.col("n") >= min_len)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("pid", "category", "action", "destination", "user")))
    counts = rows.select(*keys, "at", F.explode(F.filter(kinds, lambda x: x["value"] != "")).alias("x")).groupBy(*keys, "x.kind", "x.value").agg(F.count(F.lit(1)).alias("k"), F.min("at").alias("first"))
    counts = checkpointed(counts)
    sizes = counts.groupBy(*keys).agg(F.count_if(F.col("kind") == "pid").alias("n_pids"), F.count_if(F.col("kind") == "category").alias("span"))
    order = F.when(F.col("kind") == "user", F.lit(0)).otherwise(-F.col("k"))
    place = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(order, "first", "value"))
    shown = counts.where("kind <> 'pid' AND kind <> 'category'").withColumn("_r", place).where(F.col("_r") <= F.when(F.col("kind") == "user", users).otherwise(top))
    known = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("value")), F.lit(0)), F.lit(100)).cast("int")
    shown = shown.unionByName(counts.where("kind = 'category'").withColumn("_r", known))
    listed = lambda kind, f: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("_r", "value", "k")))), f), ", ")
    counted = lambda x: F.concat_ws(":", x["value"], x["k"].cast("string"))
    shown = shown.groupBy(*keys).agg(listed("category", lambda x: x["value"]).alias("categories"), listed("category", counted).alias("cat_counts"), listed("action", counted).alias("actions"), listed("destination", counted).alias("destinations"), listed("user", lambda x: x["value"]).alias("users"))
    rest = F.substring_index("chain_id", ":", -1)
    out = main.join(sizes, keys, "left").join(shown, keys, "left").withColumn("root_pid", F.when(F.col("chain_id").startswith("proc:"), rest).otherwise(""))
    own = F.coalesce(F.nullif("_first.command", F.lit("")), F.nullif("_first.name", F.lit("")), F.expr("substr(chain_id, instr(chain_id, ':') + 1)"))
    if names is None:
        out = out.withColumn("title", own)
    else:
        named = names.where("name <> ''").groupBy(*by, F.col("id").cast("string").alias("root_pid")).agg(F.min("name").alias("_name"))
        out = out.join(named, [*by, "root_pid"], "left").withColumn("title", F.coalesce("_name", own)).drop("_name")
    texts, numbers = ["categories", "cat_counts", "actions", "destinations", "users"], ["n_pids", "span"]
    out = out.withColumn("how", F.col("_first.how")).drop("_first").fillna("", texts).fillna(0, numbers)
    return out.orderBy(F.desc("span"), F.desc("severity"), F.desc("n"), "chain_id")


def chain_coverage(chains: DataFrame) -> DataFrame:
    """One row: how many events there are, how each kind of link led to them, and the whole per cent that strong links and all links cover."""
    counts = chains.agg(F.count(F.lit(1)).alias("events"), *(F.count_if(F.col("how") == h).alias(f"n_{h}") for h in LINK_STRENGTH))
    strong = sum((F.col(f"n_{h}") for h, x in LINK_STRENGTH.items() if x == "strong"), F.lit(0))
    every = sum((F.col(f"n_{h}") for h in LINK_STRENGTH), F.lit(0))
    share = lambda x: F.floor(x * 100 / F.greatest("events", F.lit(1)))
    return counts.withColumn("strong_pct", share(strong)).withColumn("covered_pct", share(every))
