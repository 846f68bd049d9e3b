"""Trees kept as (id, parent_id), and the permissions that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.operators.lineage import cut, positions

#: Tasks that users with the same roles are dealt to.
SALTS = 16


def _closure(start: DataFrame, step: DataFrame) -> DataFrame:
    """(root, id, depth): what start (root, id) reaches along step (id, next), itself included, each once at its least depth; cycles end there.

    A loop of joins, one for each level: only the last level's new rows go on, and every level is a table of its own.
    """
    step = cut(step.where("next is not null").distinct())
    level = cut(start.where("id is not null").select("root", "id", F.lit(0).alias("depth")).distinct())
    seen = level
    while not level.isEmpty():
        further = level.join(step, "id").select("root", F.col("next").alias("id"), (F.col("depth") + 1).alias("depth")).dropDuplicates(["root", "id"])
        level = cut(further.join(seen.select("root", "id"), ["root", "id"], "left_anti"))
        seen = seen.unionAll(level)
    return seen


def ancestors(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, id, depth): each node (id), and all above it; unknown ids stay."""
    return _closure(nodes.selectExpr("id root", "id"), tree.selectExpr("id", "parent_id next"))


def descendants(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, id, depth): each node (id), and all below it."""
    return _closure(nodes.selectExpr("id root", "id"), tree.selectExpr("parent_id id", "id next").where("id is not null"))


def paths(tree: DataFrame) -> DataFrame:
    """(id, path, depth): the names from a node's root to it. Nodes whose parent is missing are roots; nodes on a cycle, and below one, don't appear: see :func:`cycles`."""
    tree = cut(tree.select("id", "parent_id", "name"))
    rows = tree.join(tree.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", F.col("name").alias("path"), F.lit(0).alias("depth"))
    level = cut(rows)
    found = level
    while not level.isEmpty():
        up = level.select(F.col("id").alias("parent_id"), "path", "depth")
        level = cut(tree.join(up, "parent_id").select("id", F.concat("path", F.lit(" > "), "name").alias("path"), (F.col("depth") + 1).alias("depth")))
        found = found.unionAll(level)
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """(id, cycle) for the nodes of edges (id, parent_id) that lie on a cycle: the strongly connected components of more than one node, and nodes that are their own parents, named by their smallest node.

    Nodes that nothing leads to, or that lead nowhere, are trimmed first, level by level. Of what is left every node takes the
    largest node that reaches it; those that this node reaches back, among the ones that took it, are its component. That
    goes on without the components found. Each step is a join, and a table of its own; steps grow with the depth of the graph.
    """
    edges = cut(edges.where("id is not null and parent_id is not null").select("id", "parent_id").distinct())
    found = edges.where("id = parent_id").select("id", F.col("id").alias("cycle"))
    rest = cut(edges.where("id <> parent_id"))
    while not rest.isEmpty():
        n = -1
        while n != (n := rest.count()):  # trim
            inner = rest.join(rest.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi")
            rest = cut(inner.join(rest.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi").select("id", "parent_id"))
        if not n:
            break
        nodes = rest.select("id").union(rest.select("parent_id")).distinct()
        colour, moved = cut(nodes.select("id", F.col("id").alias("colour"))), True
        while moved:
            up = rest.join(colour, "id").select(F.col("parent_id").alias("id"), "colour")
            wider = cut(colour.unionAll(up).groupBy("id").agg(F.max("colour").alias("colour")))
            moved = not wider.join(colour, ["id", "colour"], "left_anti").isEmpty()
            colour = wider
        # against the edges, from each node that kept its own colour, within the colour
        back = rest.join(colour.withColumnRenamed("colour", "own"), "id").join(colour.select(F.col("id").alias("parent_id"), "colour"), "parent_id").where("own = colour").select("id", "parent_id", "colour")
        level = cut(colour.where("id = colour"))
        members = level
        while not level.isEmpty():
            further = back.join(level.select(F.col("id").alias("parent_id"), "colour"), ["parent_id", "colour"]).select("id", "colour").distinct()
            level = cut(further.join(members, ["id", "colour"], "left_anti"))
            members = members.unionAll(level)
        members = cut(members)
        sizes = members.groupBy("colour").agg(F.count("*").alias("n"), F.min("id").alias("cycle")).where("n > 1")
        found = found.unionAll(members.join(sizes, "colour").select("id", "cycle"))
        gone = members.select("id")
        rest = cut(rest.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti").select("id", "parent_id"))
    return found.groupBy("id").agg(F.min("cycle").alias("cycle"))


def ordered(tree: DataFrame) -> DataFrame:
    """(id, depth, pos) of tree (id, parent_id, name, type): depth-first, siblings by type and name; nodes whose parent is missing are roots."""
    key = F.concat_ws("\u0001", F.coalesce(F.col("type").cast("string"), F.lit("")), "name", F.col("id").cast("string"))
    laid = paths(tree.select("id", "parent_id", F.concat(key, F.lit("\u0002")).alias("name")))
    return positions(laid.select("id", "depth", F.replace("path", F.lit("\u0002 > "), F.lit("\u0002")).alias("path")), "path").select("id", "depth", "pos")


def effective(user_roles: DataFrame, roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """(user_id, code): permissions of a user's enabled roles and all above them, the enabled ones among these.

    Codes are found once for each role, then for each distinct set of roles, so that no pair of a user and a permission is shuffled.
    A set that many users have is dealt to ``SALTS`` tasks.
    """
    enabled = roles.where("status = 1").select("role_id").distinct()
    own = role_permissions.join(enabled, "role_id").select("role_id", "permission_id").distinct()
    above = ancestors(permissions, own.select(F.col("permission_id").alias("id")).distinct())
    codes = permissions.where("status = 1").select("id", "code")
    held = own.join(above.withColumnRenamed("root", "permission_id"), "permission_id").select("role_id", "id").distinct().join(codes, "id").select("role_id", "code").distinct()
    sets = cut(user_roles.join(enabled, "role_id").where("user_id is not null").groupBy("user_id").agg(F.array_sort(F.collect_set("role_id")).alias("roles")))
    opened = sets.select("roles").distinct().select("roles", F.explode("roles").alias("role_id"))
    reached = opened.join(held, "role_id").select("roles", "code").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sets.withColumn("salt", F.pmod(F.xxhash64("user_id"), F.lit(SALTS)).cast("int")).join(reached, ["roles", "salt"]).select("user_id", "code")


def allowed(users: DataFrame, codes: DataFrame, required: list[str]) -> DataFrame:
    """(user_id) of the users (user_id, is_superuser) that may act: superusers, and those that hold one at least of the required codes, as effective() gives them."""
    held = codes.where(F.col("code").isin(required)).select("user_id").distinct()
    return users.join(held.withColumn("held", F.lit(True)), "user_id", "left").where(F.coalesce("is_superuser", F.lit(False)) | F.col("held")).select("user_id")


def guarded(tree: DataFrame, bound: DataFrame) -> DataFrame:
    """(id, reason): nodes that must not be deleted: built in, with children, or bound (id) to a role."""
    reasons = [
        tree.where("is_builtin").select("id", F.lit("built in").alias("reason")),
        tree.join(tree.select(F.col("parent_id").alias("p")), F.col("id") == F.col("p"), "left_semi").select("id", F.lit("has children").alias("reason")),
        tree.join(bound.select("id").distinct(), "id", "left_semi").select("id", F.lit("bound to a role").alias("reason")),
    ]
    return reasons[0].unionAll(reasons[1]).unionAll(reasons[2])
