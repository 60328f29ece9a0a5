"""Walks over the interprocedural graph: chains between variables, features around nodes, flows with matched calls.

All take the edges of ``stitch.interprocedural`` (src, dst, label, funcall, way). A walk goes on in rounds of joins until
nothing new is found or its length is reached. Where the order of steps does not matter, equal states are added up
instead of being carried one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.common import cut
from weftline.functions import names as fn
from weftline.model import STRING_TYPE

# Kinds by their part in walks.
REFS, ASSIGNS = ("ref_var", "ref_field"), ("assign_var", "assign_field")
ARRAYS = ("ref_array", "assign_array")
ENTERED = ("call", "new", "input")
PLAIN = ("receive", "input", "output", "return", "begin", "end", "repeat", "catchjoin")
WIDENED = ("call", "op_infix", "ref_array", "ref_field", "assign_array", "assign_field")
TYPE_OPERATIONS = ("op_typecast", "op_typecheck")
CONDITIONS = ("join", "begin", "end", "case", "catchjoin")
VALUE_PASSES = ("value", "valueset", "op_assign", "op_prefix", "op_infix", "op_postfix", "op_typecast", "op_typecheck", "op_iter", "ref_array", "ref_field")
EQUIVALENT = ("ref_var", "assign_var", "op_assign", "ref_field", "assign_field", "receive", "input", "output", "join", "begin", "end", "repeat", "return")

_long = lambda v: F.lit(v).cast("long")


def is_variable(ref: Column, without: str = "#%!@") -> Column:
    """Whether a reference names a variable or field: none of the sigils ``without``."""
    return F.coalesce((F.length(ref) > 0) & ~F.left(ref, F.lit(1)).isin(*without), F.lit(False))


def _real(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("label").startswith("_"))


def _call_name(data: Column) -> Column:
    first = F.substring_index(data, " ", 1)
    return F.coalesce(fn.method_simple_name(first), F.lit("?"))


def _type_name(data: Column) -> Column:
    return F.coalesce(fn.class_simple_name(data), data, F.lit("?"))


def step_feature(kind: Column, data: Column) -> Column:
    """What a node adds to a chain: its kind and name or data; null for nodes that only pass a value on."""
    first = F.substring_index(data, " ", 1)
    named = (
        F.when(kind == "call", F.concat(F.lit("call,"), _call_name(data)))
        .when(kind == "new", F.concat(F.lit("new,"), F.coalesce(fn.class_simple_name(fn.method_class(first)), F.lit("?"))))
        .when(kind.isin(*TYPE_OPERATIONS), F.concat(kind, F.lit(","), _type_name(data)))
        .otherwise(F.concat_ws(",", kind, data))
    )
    return F.when(kind.isNull() | kind.isin(*PLAIN) | ((kind == "op_assign") & F.coalesce(data == "=", F.lit(False))), None).otherwise(named)


def side_feature(kind: Column, ref: Column, data: Column, type_: Column) -> Column:
    """What a further input of a node adds to the node's feature; null for most kinds."""
    return (
        F.when(kind.isin("call", "new"), F.concat(kind, F.lit(","), _call_name(data)))
        .when(kind.isin(*REFS, *ASSIGNS), F.concat(kind, F.lit(","), F.coalesce(fn.reference_name(ref), F.lit("?"))))
        .when((kind == "value") & F.coalesce(type_ == STRING_TYPE, F.lit(False)), F.lit("value,STRING"))
        .when(kind.isin(*TYPE_OPERATIONS), F.concat(kind, F.lit(","), _type_name(data)))
        .when(kind.isin("op_infix", "value"), F.concat(kind, F.lit(","), F.coalesce(data, F.lit("None"))))
    )


def _entered_aside(kind: Column, label: Column) -> Column:
    """Whether a link goes into a call other than as an argument."""
    return F.coalesce(kind.isin(*ENTERED), F.lit(False)) & ~label.startswith("#arg")


def chain_steps(edges: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(nid, label, dst, kind, to_ref, feats): every step that a chain may take, with its alternative features.

    ``feats`` is null where the step adds nothing, else an array of the node's own feature and of those widened by
    each further input of the node.
    """
    own = nodes.select(F.col("nid").alias("dst"), "kind", F.col("ref_name").alias("to_ref"), step_feature(F.col("kind"), F.col("ndata")).alias("f"))
    side = nodes.select(F.col("nid").alias("nid1"), side_feature(F.col("kind"), F.col("ref_name"), F.col("ndata"), F.col("ntype")).alias("g"))
    steps = _real(edges).select(F.col("src").alias("nid"), "label", "dst").distinct().join(own, "dst").where(~_entered_aside(F.col("kind"), F.col("label")))
    wide = own.where(F.col("kind").isin(*WIDENED) & F.col("f").isNotNull()).select(F.col("dst").alias("nid0"), "kind")
    more = links.where(~F.col("label").startswith("_")).join(wide, "nid0").where(~_entered_aside(F.col("kind"), F.col("label"))).join(side.where("g is not null"), "nid1")
    more = more.select(F.col("nid0").alias("dst"), F.col("label").alias("k"), F.col("nid1").alias("other"), F.concat("label", F.lit(","), "g").alias("g")).distinct()
    sides = more.groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("g", "k", "other"))).alias("sides"))
    joined = steps.join(sides, "dst", "left")
    # the widening inputs are neither the one the chain comes from nor of the same label
    fitting = F.filter(F.coalesce("sides", F.array().cast("array<struct<g:string,k:string,other:bigint>>")), lambda x: (x["other"] != F.col("nid")) & (x["k"] != F.col("label")))
    feature = F.concat("label", F.lit(","), "f")
    feats = F.when(F.col("f").isNotNull(), F.concat(F.array(feature), F.transform(fitting, lambda x: F.concat(feature, F.lit("|"), x["g"]))))
    return joined.select("nid", "label", "dst", "kind", "to_ref", feats.alias("feats"))


def variable_chains(steps: DataFrame, starts: DataFrame, most: int = 8) -> DataFrame:
    """(from_ref, to_ref, n_nodes, n): chains of up to ``most`` nodes from a reading (nid, from_ref) to the next assignment.

    ``steps`` are those of ``chain_steps``. All chains count, whatever their number; ways of one length between
    the same ends are added up.
    """
    hit = F.coalesce(F.col("kind").isin(*ASSIGNS), F.lit(False))
    edges = cut(steps.groupBy("nid", "dst", "to_ref", hit.alias("hit")).agg(F.count(F.lit(1)).alias("ways")))
    front = starts.groupBy("nid", "from_ref").agg(F.count(F.lit(1)).alias("n"))
    done = None
    for k in range(2, most + 1):
        moved = front.join(edges, "nid").groupBy("from_ref", "dst", "hit", "to_ref").agg(F.sum(F.col("n") * F.col("ways")).alias("n"))
        moved = cut(moved)
        hits = moved.where("hit").where(is_variable(F.col("to_ref"))).groupBy("from_ref", "to_ref").agg(F.sum("n").alias("n")).withColumn("n_nodes", _long(k))
        done = hits if done is None else done.unionByName(hits)
        front = moved.where("not hit").select("from_ref", F.col("dst").alias("nid"), "n")
    return done.where("from_ref <> to_ref").select("from_ref", "to_ref", "n_nodes", "n")


def chain_keys(steps: DataFrame, starts: DataFrame, most: int = 8, least_key: int = 2) -> DataFrame:
    """(from_ref, to_ref, chain_key, n): the chains of ``variable_chains`` by every combination of their steps' features.

    Steps without features add none. Keys of fewer than ``least_key`` features are left out.
    """
    hit = F.coalesce(F.col("kind").isin(*ASSIGNS), F.lit(False))
    edges = cut(steps.select("nid", "dst", "to_ref", hit.alias("hit"), F.explode(F.coalesce("feats", F.array(F.lit(None).cast("string")))).alias("feat")).groupBy("nid", "dst", "to_ref", "hit", "feat").agg(F.count(F.lit(1)).alias("ways")))
    front = starts.groupBy("nid", "from_ref").agg(F.count(F.lit(1)).alias("n")).select("nid", "from_ref", F.lit("").alias("key"), _long(0).alias("size"), "n")
    done = None
    for _ in range(2, most + 1):
        key = F.when(F.col("feat").isNull(), F.col("key")).when(F.col("size") == 0, F.col("feat")).otherwise(F.concat("key", F.lit(" "), "feat"))
        size = F.col("size") + F.col("feat").isNotNull().cast("long")
        moved = cut(front.join(edges, "nid").groupBy("from_ref", "dst", "hit", "to_ref", key.alias("key"), size.alias("size")).agg(F.sum(F.col("n") * F.col("ways")).alias("n")))
        hits = moved.where("hit").where(is_variable(F.col("to_ref")) & (F.col("size") >= least_key)).select("from_ref", "to_ref", "key", "n")
        done = hits if done is None else done.unionByName(hits)
        front = moved.where("not hit").select(F.col("dst").alias("nid"), "from_ref", "key", "size", "n")
    return done.where("from_ref <> to_ref").groupBy("from_ref", "to_ref", F.col("key").alias("chain_key")).agg(F.sum("n").alias("n"))


def noun_chains(steps: DataFrame, starts: DataFrame, most: int = 5) -> DataFrame:
    """(from_ref, to_ref, chain_key, n): simple ways from a reading (nid, from_ref) to every assignment on them.

    A way has up to ``most`` features and visits no node twice; steps without features do not count. Unlike a chain it
    goes on through assignments.
    """
    assigned = F.coalesce(F.col("kind").isin(*ASSIGNS) & is_variable(F.col("to_ref"), "#%"), F.lit(False))
    edges = cut(steps.select("nid", "dst", "to_ref", assigned.alias("hit"), F.explode(F.coalesce("feats", F.array(F.lit(None).cast("string")))).alias("feat")))
    front = starts.select("nid", "from_ref", F.array("nid").alias("way"), F.lit("").alias("key"), _long(0).alias("size"))
    done = None
    while True:
        moved = front.join(edges, "nid").where(~F.array_contains("way", F.col("dst")) & (F.col("size") + F.col("feat").isNotNull().cast("long") <= most))
        key = F.when(F.col("feat").isNull(), F.col("key")).when(F.col("size") == 0, F.col("feat")).otherwise(F.concat("key", F.lit(" "), "feat"))
        moved = cut(moved.select(F.col("dst").alias("nid"), "from_ref", F.concat("way", F.array("dst")).alias("way"), key.alias("key"), (F.col("size") + F.col("feat").isNotNull().cast("long")).alias("size"), "hit", "to_ref"))
        hits = moved.where("hit and size > 0").select("from_ref", "to_ref", "key")
        done = hits if done is None else done.unionByName(hits)
        front = moved.where(F.col("size") < most).select("nid", "from_ref", "way", "key", "size")
        if front.isEmpty():
            break
    return done.where("from_ref <> to_ref").groupBy("from_ref", "to_ref", F.col("key").alias("chain_key")).agg(F.count(F.lit(1)).alias("n"))


def call_ways(steps: DataFrame, starts: DataFrame, most: int = 5) -> DataFrame:
    """(callee, way, feat, n): the features on simple ways from calls (nid, callee), up to ``most`` of them.

    ``steps`` has (nid, dst, way, f): one row per direction ``way`` of a link with the feature of the step, null if it
    adds none. Every feature that a way gathers gives one row of all features up to it.
    """
    front = starts.select("nid", "callee", F.array("nid").alias("seen"), F.lit("").alias("feat"), _long(0).alias("size"), F.explode(F.array(F.lit("forward"), F.lit("backward"))).alias("way"))
    done = None
    while True:
        moved = front.join(steps, ["nid", "way"]).where(~F.array_contains("seen", F.col("dst")))
        gained = F.col("f").isNotNull()
        moved = cut(moved.select(F.col("dst").alias("nid"), "callee", "way", F.concat("seen", F.array("dst")).alias("seen"), F.when(gained, F.concat("feat", F.lit("/"), "f")).otherwise(F.col("feat")).alias("feat"), (F.col("size") + gained.cast("long")).alias("size"), gained.alias("gained")))
        hits = moved.where("gained").select("callee", "way", "feat")
        done = hits if done is None else done.unionByName(hits)
        front = moved.where(F.col("size") < most).drop("gained")
        if front.isEmpty():
            break
    return done.groupBy("callee", "way", "feat").agg(F.count(F.lit(1)).alias("n"))


def node_features(nodes: DataFrame, word_names: bool = True) -> DataFrame:
    """(nid, kind, ref_name, ws, fs): the name features and the other features of every node, as arrays.

    Of calls the words of the name; of references the words of their name, of elements those of their type; of
    other kinds the kind with its data. Whether a reference is the item's own is decided in the walk.
    """
    kind, ref, data = F.col("kind"), F.col("ref_name"), F.col("ndata")
    tagged = lambda words, between: F.transform(words, lambda w: F.concat(kind, F.lit(between), w))
    none = F.array().cast("array<string>")
    is_ref = kind.isin(*REFS, *ASSIGNS, *ARRAYS)
    element = is_ref & ref.startswith("%")
    words = tagged(fn.split_words(fn.strip_id(ref)), ":") if word_names else F.array(kind)
    ws = F.when(kind.isin("call", "new"), tagged(fn.split_words(fn.method_simple_name(F.substring_index(data, " ", 1))), ":")).when(is_ref & ~element, words).otherwise(none)
    fs = (
        F.when(kind.isin("call", "new"), none)
        .when(element, tagged(fn.type_words(F.substring(ref, 2, 1 << 20)), ":%"))
        .when(is_ref, none)
        .when(kind.isin(*CONDITIONS), F.array(kind))
        .when((kind == "value") & F.coalesce(F.col("ntype") == STRING_TYPE, F.lit(False)), F.array(F.lit("value:STRING")))
        .when(kind.isin(*TYPE_OPERATIONS) & data.isNotNull(), tagged(fn.type_words(data), ":"))
        .otherwise(F.array(F.concat_ws(":", kind, data)))
    )
    return nodes.select("nid", "kind", "ref_name", F.coalesce(ws, none).alias("ws"), F.coalesce(fs, none).alias("fs"))


def feature_walk(edges: DataFrame, feats: DataFrame, starts: DataFrame, budget: int = 50, node_cost: int = 10) -> DataFrame:
    """(item, root, feat): the features around nodes (nid, item), backward with negative distances and forward with positive ones.

    A feature is 'distance,previous,link:own'. Every node costs one, a node with features ``node_cost`` more; a walk ends with
    its budget. Transparent kinds keep the distance. A call that is entered through its result (its argument) is left
    through its own arguments (result) only. All ways are followed, so the result depends on no order of visits;
    of equal states the one with most budget goes on.
    """
    back = edges.select(F.lit(-1).alias("way"), F.col("dst").alias("nid"), F.col("src").alias("far"), "label", "funcall", F.col("way").alias("via"))
    forth = edges.select(F.lit(1).alias("way"), F.col("src").alias("nid"), F.col("dst").alias("far"), "label", "funcall", F.col("way").alias("via"))
    usable = ~F.col("label").startswith("_") | (F.col("label") == "_end")
    plain = F.when(F.left("label", F.lit(1)).isin("@", "%"), "").otherwise(F.col("label"))
    kinds = feats.select("nid", F.col("kind").alias("own"))
    steps = back.unionByName(forth).where(usable).join(kinds, "nid")
    # what an array holds does not flow through its element
    within = ((F.col("way") == -1) & (F.coalesce(F.col("own") == "ref_array", F.lit(False))) | (F.col("way") == 1) & (F.coalesce(F.col("own") == "assign_array", F.lit(False)))) & (F.col("label") == "")
    steps = steps.where(~within).select("way", "nid", "far", plain.alias("label"), "funcall", "via").distinct()
    about = feats.withColumnRenamed("nid", "far")
    steps = cut(steps.join(about, "far"))
    front = starts.select("item", F.col("nid").alias("root"), "nid", F.explode(F.array(F.lit(-1), F.lit(1))).alias("way"), F.lit("\x00").alias("lprev"), F.lit("").alias("fprev"), F.lit(0).alias("dist"), F.array().cast("array<bigint>").alias("calls"), F.lit(budget - 1).alias("left")).distinct()
    state = ["item", "root", "nid", "way", "lprev", "fprev", "dist", "calls"]
    top, empty = F.try_element_at("calls", F.lit(-1)), F.size("calls") == 0
    entering = F.when(F.col("way") == -1, "out").otherwise("in")

    def expanded(front: DataFrame) -> DataFrame:
        x = front.join(steps, ["nid", "way"]).where("left >= 0")
        enters, leaves = F.col("via") == entering, F.col("via").isNotNull() & (F.col("via") != entering)
        x = x.where(F.coalesce(~leaves, F.lit(True)) | empty | (top == F.col("funcall")))
        calls = F.when(enters, F.concat("calls", F.array("funcall"))).when(leaves & ~empty, F.slice("calls", 1, F.size("calls") - 1)).otherwise(F.col("calls"))
        # the label of a feature is that of the link by which its node was reached; transparent nodes pass it on
        label = F.when(F.col("lprev") == "\x00", F.col("label")).otherwise(F.col("lprev"))
        thin = F.col("kind").isNull() | F.col("kind").isin("receive", "input", "output", "repeat") | F.when(F.col("way") == -1, F.col("kind") == "assign_var").otherwise(F.col("kind") == "ref_var")
        itself = F.coalesce(F.col("kind").isin(*REFS, *ASSIGNS, *ARRAYS) & (F.col("ref_name") == F.col("item")), F.lit(False))
        ws = F.when(itself, F.array().cast("array<string>")).otherwise(F.col("ws"))
        fs = F.when(itself, F.array(F.concat("kind", F.lit(":SELF")))).otherwise(F.concat("ws", "fs"))
        return x.select("item", "root", F.col("far").alias("nid"), "way", label.alias("l"), "fprev", "dist", calls.alias("calls"), "left", F.coalesce(thin, F.lit(True)).alias("thin"), "kind", ws.alias("ws"), fs.alias("fs"))

    def moved(x: DataFrame) -> DataFrame:
        passing = F.coalesce(F.when(F.col("way") == -1, F.col("kind") == "ref_var").otherwise(F.col("kind") == "assign_var"), F.lit(False))
        # a node hands on the state as it is, or starts anew behind each of its name features or its first other one
        own = F.when(F.size("ws") > 0, F.transform("ws", lambda w: F.concat("l", F.lit(":"), w))).otherwise(F.array(F.concat("l", F.lit(":"), F.get("fs", F.lit(0)))))
        through = F.col("thin") | passing
        x = x.where("thin or size(fs) > 0").withColumn("fprev", F.explode(F.when(through, F.array("fprev")).otherwise(own)))
        x = x.select("item", "root", "nid", "way", F.when(through, F.col("l")).otherwise("\x00").alias("lprev"), "fprev", F.when(through, F.col("dist")).otherwise(F.col("dist") + 1).alias("dist"), "calls", F.when(through, F.col("left") - 1).otherwise(F.col("left") - 1 - node_cost).alias("left"))
        return x.where("left >= 0").groupBy(*state).agg(F.max("left").alias("left"))

    front = cut(front)
    every, known = front, front.groupBy(*state).agg(F.max("left").alias("had"))
    while True:
        front = cut(moved(expanded(front)).join(known, state, "left").where("had is null or had < left").drop("had"))
        if front.isEmpty():
            break
        every = every.unionByName(front)
        known = every.groupBy(*state).agg(F.max("left").alias("had"))
    best = every.groupBy(*state).agg(F.max("left").alias("left"))
    own = expanded(best).where("not thin and size(fs) > 0")
    far = (F.col("way") * (F.col("dist") + 1)).cast("string")
    feat = F.explode(F.transform("fs", lambda f: F.concat_ws(",", far, F.col("fprev"), F.concat("l", F.lit(":"), f))))
    return own.select("item", "root", feat.alias("feat")).distinct()


def matched_flows(edges: DataFrame, nodes: DataFrame, starts: DataFrame, most_calls: int | None = None) -> DataFrame:
    """(src_ref, dst_ref, n_contexts): flows between variables and fields, backward from nodes (nid), calls and returns matched.

    Entering a callee through its result pushes the call, which may be on the stack once; entering the caller through
    an argument needs the call on top. A variable belongs to its context of calls, a field to all. Between two references
    lie only nodes without one. ``most_calls`` bounds the stack, if given.
    """
    own = is_variable(F.col("ref_name"), "#%!@") & F.left("ref_name", F.lit(1)).isin("$", ".") & ~F.coalesce(F.col("kind").isin(*VALUE_PASSES), F.lit(False))
    refs = nodes.select("nid", F.when(own, F.col("ref_name")).alias("ref"))
    steps = cut(_real(edges).select(F.col("dst").alias("nid"), F.col("src").alias("far"), "funcall", "way").distinct().join(refs.select(F.col("nid").alias("far"), "ref"), "far"))
    none = F.array().cast("array<bigint>")
    # a reference of a context: the stack for variables, nothing for fields
    context = lambda ref, calls: F.when(F.left(ref, F.lit(1)) == "$", calls)
    top = F.try_element_at("calls", F.lit(-1))
    room = F.lit(True) if most_calls is None else F.size("calls") < most_calls

    def expanded(front: DataFrame) -> DataFrame:
        x = front.join(steps, "nid")
        allowed = F.when(F.col("way") == "out", ~F.array_contains("calls", F.col("funcall")) & room).when(F.col("way") == "in", F.coalesce(top == F.col("funcall"), F.lit(False))).otherwise(F.lit(True))
        calls = F.when(F.col("way") == "out", F.concat("calls", F.array("funcall"))).when(F.col("way") == "in", F.slice("calls", 1, F.size("calls") - 1)).otherwise(F.col("calls"))
        x = x.where(allowed).select(F.col("far").alias("nid"), calls.alias("calls"), "ref", "dst_ref", "dst_in")
        return x.withColumn("src_in", context(F.col("ref"), F.col("calls")))

    front = starts.select("nid").distinct().join(refs, "nid").select("nid", none.alias("calls"), F.col("ref").alias("dst_ref"), context(F.col("ref"), none).alias("dst_in"))
    seen = front = cut(front)
    while True:
        x = expanded(front)
        moved = x.select("nid", "calls", F.coalesce("ref", "dst_ref").alias("dst_ref"), F.when(F.col("ref").isNotNull(), F.col("src_in")).otherwise(F.col("dst_in")).alias("dst_in")).distinct()
        same = [moved["nid"] == seen["nid"], moved["calls"] == seen["calls"], moved["dst_ref"].eqNullSafe(seen["dst_ref"]), moved["dst_in"].eqNullSafe(seen["dst_in"])]
        front = cut(moved.join(seen, same, "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    different = (F.col("src_ref") != F.col("dst_ref")) | ~F.col("src_in").eqNullSafe(F.col("dst_in"))
    flows = expanded(seen).where("ref is not null and dst_ref is not null").select(F.col("ref").alias("src_ref"), "src_in", "dst_ref", "dst_in")
    return flows.where(different).distinct().groupBy("src_ref", "dst_ref").agg(F.count(F.lit(1)).alias("n_contexts"))


def longest_ways(edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(start, nid, assigned, n_nodes): the longest way of up to ``most`` nodes from each input that nothing feeds to each output or return.

    Assignments of variables count first, then nodes. A way that enters a callee leaves it at the same call, and ends where
    it has left all. Of the ways of one length to a place, only the one with most assignments can become the longest.
    """
    kinds = nodes.select(F.col("nid").alias("dst"), F.coalesce(F.col("kind") == "assign_var", F.lit(False)).cast("long").alias("one"), F.coalesce(F.col("kind").isin("output", "return"), F.lit(False)).alias("ends"))
    steps = cut(_real(edges).select(F.col("src").alias("nid"), "dst", "funcall", "way").distinct().join(kinds, "dst"))
    fed = steps.select(F.col("dst").alias("nid"))
    front = nodes.where("kind = 'input'").join(fed, "nid", "left_anti").select(F.col("nid").alias("start"), "nid", F.array().cast("array<bigint>").alias("stack"), _long(0).alias("a"))
    top, found = F.try_element_at("stack", F.lit(-1)), None
    for k in range(2, most + 1):
        x = front.join(steps, "nid")
        allowed = F.when(F.col("way") == "in", ~F.array_contains("stack", F.col("funcall"))).when(F.col("way") == "out", F.coalesce(top == F.col("funcall"), F.lit(False))).otherwise(F.lit(True))
        stack = F.when(F.col("way") == "in", F.concat("stack", F.array("funcall"))).when(F.col("way") == "out", F.slice("stack", 1, F.size("stack") - 1)).otherwise(F.col("stack"))
        moved = cut(x.where(allowed).groupBy("start", F.col("dst").alias("nid"), stack.alias("stack"), "ends").agg(F.max(F.col("a") + F.col("one")).alias("a")))
        hits = moved.where("ends and size(stack) = 0").select("start", "nid", F.struct(F.col("a").alias("assigned"), _long(k).alias("n_nodes")).alias("x"))
        found = hits if found is None else found.unionByName(hits)
        front = moved.select("start", "nid", "stack", "a")
    return found.groupBy("start", "nid").agg(F.max("x").alias("x")).select("start", "nid", "x.assigned", "x.n_nodes")


def shortest_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_ref, to_ref, n): the shortest backward chain, in nodes, from a reference to the next one over kinds that keep the value."""
    ref, kind = F.col("ref_name"), F.col("kind")
    plain = kind.isNull() | (kind.isin(*EQUIVALENT) & ((kind != "op_assign") | F.coalesce(F.col("ndata") == "=", F.lit(False))))
    about = nodes.select("nid", F.when(~F.left(ref, F.lit(1)).isin("#"), ref).alias("ref"), F.coalesce(plain, F.lit(False)).alias("plain"), F.coalesce("kind", F.lit("")).alias("kind"))
    wanted = F.when(F.col("kind") == "op_assign", F.col("label") == "R").when(F.col("kind").isin("ref_field", "assign_field", "end", "repeat"), F.col("label") == "").when(F.col("kind") == "join", F.col("label").isin("true", "false")).otherwise(F.lit(True))
    steps = _real(edges).select(F.col("dst").alias("nid"), F.col("src").alias("far"), "label").join(about.where("plain").select("nid", "kind"), "nid").where(wanted)
    steps = cut(steps.select("nid", "far").distinct().join(about.select(F.col("nid").alias("far"), "ref"), "far"))
    front = cut(about.where("ref is not null and left(ref, 1) <> '%'").select(F.col("ref").alias("to_ref"), "nid", _long(1).alias("n")).distinct())
    seen = front
    while True:
        onward = front.join(steps, "nid").where("ref is null").groupBy("to_ref", F.col("far").alias("nid")).agg((F.min("n") + 1).alias("n"))
        front = cut(onward.join(seen, ["to_ref", "nid"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    hits = seen.join(steps, "nid").where("ref is not null and left(ref, 1) <> '%'").select(F.col("ref").alias("from_ref"), "to_ref", (F.col("n") + 1).alias("n"))
    return hits.where("from_ref <> to_ref").groupBy("from_ref", "to_ref").agg(F.min("n").alias("n"))


def generalisation_edges(links: DataFrame) -> DataFrame:
    """(sup, sub): a reference that two or more flow into, or that flows into two or more, stands above these."""
    into = links.groupBy(F.col("to_ref").alias("sup")).agg(F.collect_set("from_ref").alias("subs")).where(F.size("subs") > 1)
    out = links.groupBy(F.col("from_ref").alias("sup")).agg(F.collect_set("to_ref").alias("subs")).where(F.size("subs") > 1)
    return into.unionByName(out).select("sup", F.explode("subs").alias("sub")).distinct()


def reach_until(starts: DataFrame, edges: DataFrame, stop: Callable[[DataFrame], Column], nodes: DataFrame) -> DataFrame:
    """(start, nid, ref_name): the first nodes backward from each start (nid, start) that satisfy ``stop``, on every way.

    ``stop`` gets the frame of reached nodes with their columns, ``start`` among them.
    """
    steps = cut(_real(edges).select(F.col("dst").alias("nid"), F.col("src").alias("far")).distinct().join(nodes.withColumnRenamed("nid", "far"), "far"))

    def expanded(front: DataFrame) -> DataFrame:
        x = front.join(steps, "nid").drop("nid").withColumnRenamed("far", "nid").distinct()
        return x.withColumn("stops", F.coalesce(stop(x), F.lit(False)))

    seen = front = cut(starts.select("start", "nid").distinct())
    while True:
        front = cut(expanded(front).where("not stops").select("start", "nid").distinct().join(seen, ["start", "nid"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return expanded(seen).where("stops").select("start", "nid", "ref_name").distinct()


def call_order(calls: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mid, call_before, call_after): which call of a method comes next after which by the flow of data; null for its entry and its exit.

    ``calls`` has (nid, mid), ``edges`` (src, dst) the links within methods. The next ones after a call are the first calls
    on every way on from it; ways without one lead to the exit. The first ones are reached from nodes that nothing feeds.
    """
    own = nodes.where("mid is not null").select("nid", "mid")
    inner = cut(edges.join(own.select(F.col("nid").alias("src"), "mid"), "src").select("mid", "src", "dst").distinct())
    fed, feeding = inner.select(F.col("dst").alias("nid")).distinct(), inner.select(F.col("src").alias("nid")).distinct()
    is_call = calls.where("mid is not null").select("nid", F.lit(True).alias("is_call")).distinct()
    with_calls = calls.where("mid is not null").select("mid").distinct()
    sources = own.join(with_calls, "mid", "left_semi").join(fed, "nid", "left_anti")
    entered = sources.join(is_call, "nid", "left")
    found = entered.where("is_call").select("mid", F.lit(None).cast("long").alias("call_before"), F.col("nid").alias("call_after"))
    front = entered.where("is_call is null").select("mid", F.lit(None).cast("long").alias("call_before"), "nid").unionByName(calls.where("mid is not null").select("mid", F.col("nid").alias("call_before"), "nid").distinct())
    front = cut(front)
    ended = feeding.withColumn("goes_on", F.lit(True))
    seen = front
    while True:
        stops = front.join(ended, "nid", "left").where("goes_on is null").select("mid", "call_before", F.lit(None).cast("long").alias("call_after"))
        moved = front.join(inner.withColumnRenamed("src", "nid"), ["mid", "nid"]).select("mid", "call_before", F.col("dst").alias("nid")).distinct().join(is_call, "nid", "left")
        found = found.unionByName(stops).unionByName(moved.where("is_call").select("mid", "call_before", F.col("nid").alias("call_after")))
        rest = moved.where("is_call is null").select("mid", "call_before", "nid")
        front = cut(rest.join(seen, (rest["mid"] == seen["mid"]) & rest["call_before"].eqNullSafe(seen["call_before"]) & (rest["nid"] == seen["nid"]), "left_anti"))
        if front.isEmpty():
            return found.distinct()
        seen = seen.unionByName(front)
