"""Readers of the text formats: every line is a row of ``spark.read.text``, split and cast by
columns.  A line that doesn't fit its layout is skipped unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, line) without carriage returns."""
    r = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return r.text(paths).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"\r$", "").alias("line"))


def numbers(line: Column, sep: str = r"[ ,;\t]+") -> Column:
    """Numbers of a line; a part that isn't one is null."""
    return F.transform(F.split(F.trim(line), sep), lambda v: v.try_cast("double"))


def _wholes(rows: DataFrame, column: str = "v") -> DataFrame:
    return rows.where(~F.exists(column, lambda v: v.isNull()))


def imu(spark: SparkSession, paths: str | list[str], imu_id: int = 0) -> DataFrame:
    """(path, ts, ts_unix in seconds, gyr_x..z, acc_x..z, imu_id).

    Files with a header name their columns and keep rows without an id or with a negative one;
    files without have 7 numbers, then perhaps an id (0 if absent) and a unix time, and need ts > 0.
    """
    rows = lines(spark, paths).withColumn("parts", F.split(F.trim("line"), r"[ ,\t]+"))
    is_head = F.lower(F.element_at("parts", 1)).rlike("[a-z]")
    heads = rows.where(is_head & F.array_contains("parts", "timestamp")).groupBy("path").agg(F.first("parts").alias("head"))  # one short row a file
    body = rows.where(~is_head & (F.size("parts") >= 7)).join(heads, "path", "left").withColumn("v", F.transform("parts", lambda x: x.try_cast("double")))

    def named(name: str, place: int) -> Column:
        at = F.array_position("head", name).cast("int")
        return F.when(F.col("head").isNull(), F.get("v", F.lit(place))).when(at > 0, F.get("v", at - 1))

    own = F.coalesce(named("imuId", 7), F.when(F.col("head").isNull(), 0.0)).cast("int")
    ns = named("timestamp", 0)
    fields = [("gyr_x", "gyroX", 1), ("gyr_y", "gyroY", 2), ("gyr_z", "gyroZ", 3), ("acc_x", "accX", 4), ("acc_y", "accY", 5), ("acc_z", "accZ", 6)]
    out = body.select("path", (ns / 1e9).alias("ts"), (named("timestampUnix", 8) / 1e9).alias("ts_unix"), *[named(b, i).cast("float").alias(a) for a, b, i in fields], own.alias("imu_id"), F.col("head").isNotNull().alias("has_head"))
    keep = F.when(F.col("has_head"), F.col("imu_id").isNull() | (F.col("imu_id") < 0) | (F.col("imu_id") == imu_id)).otherwise((F.col("ts") > 0) & (F.col("imu_id") == imu_id))
    return out.where(keep & F.col("ts").isNotNull() & F.col("acc_z").isNotNull()).drop("has_head")


def trajectory(spark: SparkSession, paths: str | list[str], layout: str = "auto", quaternion: str = "wxyz") -> DataFrame:
    """(path, ts_ns, pose, ts_unix_ns, om, fi, ka) of a trajectory file.

    ``auto``: 13, 14 or 17 numbers: ts, row-major 3x4 pose, then unix time, then angles.
    ``quaternion``: 8 numbers, ts x y z and a quaternion in the given order.
    """
    from pointloom.functions.pose import from_quaternion

    rows = _wholes(lines(spark, paths).withColumn("v", numbers(F.col("line"))).where("length(trim(line)) > 0"))
    v = [F.get("v", F.lit(i)) for i in range(17)]
    if layout == "quaternion":
        q = {n: v[4 + i] for i, n in enumerate(quaternion)}
        return rows.where("size(v) = 8").select("path", v[0].cast("long").alias("ts_ns"), from_quaternion(v[1], v[2], v[3], *[q[n] for n in "wxyz"]).alias("pose"))
    rows = rows.where(F.size("v").isin(13, 14, 17))
    pose = F.concat(F.slice("v", 2, 12), F.array(*[F.lit(float(x)) for x in (0, 0, 0, 1)]))
    long_at = lambda i: F.regexp_extract(F.trim("line"), r"^(?:\S+[ ,;\t]+){%d}(-?\d+)" % i, 1).try_cast("long")
    return rows.select("path", F.coalesce(long_at(0), v[0].cast("long")).alias("ts_ns"), pose.alias("pose"), F.when(F.size("v") >= 14, F.coalesce(long_at(13), F.get("v", F.lit(13)).cast("long"))).alias("ts_unix_ns"), *[F.get("v", F.lit(14 + i)).alias(n) for i, n in enumerate(("om", "fi", "ka"))])


def fused_trajectory(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Semicolon files with a header: timestamp;t0;t1;t2;r00..r22."""
    from pointloom.functions.pose import from_rows

    rows = _wholes(lines(spark, paths).withColumn("v", numbers(F.col("line"), r"\s*;\s*"))).where("size(v) = 13")
    v = [F.get("v", F.lit(i)) for i in range(17)]
    return rows.select("path", v[0].alias("ts"), from_rows([v[4 + i] for i in range(9)], [v[1], v[2], v[3]]).alias("pose"))


def tum(spark: SparkSession, paths: str | list[str], from_first: bool = False) -> DataFrame:
    """(path, ts, tx, ty, tz, qx, qy, qz, qw); # begins a comment; not finite rows go.
    ``from_first`` expresses poses in the frame of each file's first."""
    rows = _wholes(lines(spark, paths).where("not trim(line) like '#%' and length(trim(line)) > 0").withColumn("v", F.slice(numbers(F.col("line")), 1, 8))).where("size(v) = 8")
    rows = rows.where(~F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    names = ("ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw")
    out = rows.select("path", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if not from_first:
        return out
    from pointloom.functions import pose as P

    posed = out.withColumn("__p", P.from_quaternion("tx", "ty", "tz", "qw", "qx", "qy", "qz"))
    first = posed.groupBy("path").agg(F.min_by("__p", "ts").alias("__f"))
    moved = posed.join(first, "path").withColumn("__p", P.product(P.inverse("__f"), "__p")).withColumn("__q", P.to_quaternion("__p"))
    m = F.col("__p")
    return moved.select("path", "ts", m[3].alias("tx"), m[7].alias("ty"), m[11].alias("tz"), *[F.col(f"__q.{q}").alias(q) for q in ("qx", "qy", "qz", "qw")])


def gnss(spark: SparkSession, paths: str | list[str], undulation: bool = True) -> DataFrame:
    """Fixes from text of at least 10 columns; latitude, longitude and altitude must be finite and
    not zero.  Column 7 is the undulation (height = alt + it) or the height itself."""
    rows = lines(spark, paths).withColumn("v", numbers(F.col("line"), " +")).where("size(v) >= 10")
    names = ("ts", "lat", "lon", "alt", "hdop", "sats", "col7", "age", "time", "fix")
    out = rows.select("path", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])
    for n in ("lat", "lon", "alt"):
        out = out.where(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) & (F.col(n) != 0))
    return out.withColumn("height", F.col("alt") + F.col("col7") if undulation else F.col("col7")).drop("col7")


def nmea(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, lidar_ns, unix_ns, lat, lon, fix, ...) of stamped GGA sentences with a right checksum."""
    from pointloom.functions import nmea as N

    rows = lines(spark, paths).withColumn("s", N.stamped("line")).where("s is not null").where(N.valid("s.sentence"))
    return rows.withColumn("g", N.gga("s.sentence")).where("g is not null").select("path", "s.lidar_ns", "s.unix_ns", "g.*")


def pose_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, pose) of a list: a count, then a name and four rows of four numbers for each pose.
    Such a list has a few lines a scan and is read whole."""
    text = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\r", ""), r"\n").alias("l"))
    rows = text.select("l", F.explode(F.sequence(F.lit(0), F.element_at("l", 1).cast("int") - 1)).alias("i")).where(F.element_at("l", 1).cast("int") > 0)
    block = F.slice("l", F.col("i") * 5 + 3, F.lit(4))
    return rows.select(F.trim(F.element_at("l", F.col("i") * 5 + 2)).alias("name"), F.flatten(F.transform(block, lambda x: numbers(x, r"\s+"))).alias("pose"))


def sensor_ids(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(lidar_id, serial) from lines of an id and a serial; others are skipped."""
    p = r"^\s*(\d+)\s+(\S+)\s*$"
    return lines(spark, paths).where(F.col("line").rlike(p)).select(F.regexp_extract("line", p, 1).cast("int").alias("lidar_id"), F.regexp_extract("line", p, 2).alias("serial"))


CALIBRATION = T.StructType(
    [
        T.StructField("calibration", T.MapType(T.StringType(), T.StructType([T.StructField("identity", T.StringType()), T.StructField("order", T.StringType()), T.StructField("inverted", T.StringType()), T.StructField("data", T.ArrayType(T.DoubleType()))]))),
        T.StructField("imuToUse", T.StringType()),
        T.StructField("blacklist", T.ArrayType(T.StringType())),
    ]
)


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """(serial, pose) of a calibration file without the blacklisted sensors.

    ``identity`` gives the unit pose; data are 16 numbers by rows unless ``order`` is COLUMN;
    ``inverted`` ones are inverted.  A file that isn't such JSON gives no rows.
    """
    from pointloom.functions import pose as P
    from pointloom.functions.geometry import truth

    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", CALIBRATION).alias("d")).select("d.*").where("calibration is not null")
    rows = doc.select(F.explode("calibration").alias("serial", "x"), F.coalesce("blacklist", F.array()).alias("banned")).where(~F.array_contains("banned", F.col("serial")))
    data = F.col("x.data")
    turned = F.array(*[data[4 * j + i] for i in range(4) for j in range(4)])
    own = F.when(F.upper("x.order") == "COLUMN", turned).otherwise(data)
    own = F.when(truth("x.inverted"), P.inverse(own)).otherwise(own)
    return rows.select("serial", F.when(truth("x.identity"), P.identity()).when(F.size(data) == 16, own).alias("pose")).where("pose is not null")


def imu_to_use(spark: SparkSession, path: str) -> str:
    """The sensor named in a calibration file, or an empty string."""
    row = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.imuToUse").alias("v"), F.regexp_extract("value", r'"imuToUse"\s*:\s*(")', 1).alias("q")).first()
    return row["v"] if row and row["v"] and row["q"] else ""


def combined_calibration(ids: DataFrame, calibrations: DataFrame) -> DataFrame:
    """(lidar_id, pose): every sensor must have a calibration; without any the result is empty."""
    from pointloom.operators.joins import required_join

    if calibrations.isEmpty():
        return calibrations.select(F.lit(0).alias("lidar_id"), "pose").limit(0)
    return required_join(ids, calibrations, "serial").select("lidar_id", "pose")


SESSION = "`Session Settings` struct<offset_x:double,offset_y:double,offset_z:double,folder_name:string,out_folder_name:string>, loop_closure_edges array<struct<index_from:int,index_to:int,px:double,py:double,pz:double,om:double,fi:double,ka:double>>, laz_file_names array<struct<file_name:string>>"


def session(spark: SparkSession, path: str) -> DataFrame:
    """One row: offset_x.., files (array), edges (array), from a session file; missing parts are empty."""
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", SESSION).alias("d")).select("d.*")
    s = F.col("`Session Settings`")
    return d.select(*[F.coalesce(s[f"offset_{a}"], F.lit(0.0)).alias(f"offset_{a}") for a in "xyz"], F.coalesce(F.transform("laz_file_names", lambda x: x["file_name"]), F.array().cast("array<string>")).alias("files"), F.col("loop_closure_edges").alias("edges"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """(obs_id, scan_id, x, y, z) from nested picks."""
    schema = "observations array<array<struct<scan_id:int,local_coords:array<double>>>>"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", schema)["observations"].alias("o"))
    return d.select(F.posexplode("o").alias("obs_id", "picks")).select("obs_id", F.explode("picks").alias("p")).select("obs_id", "p.scan_id", *[F.col("p.local_coords")[i].alias(n) for i, n in enumerate("xyz")])


def int_list(spark: SparkSession, path: str) -> DataFrame:
    """(i, value) of a JSON list of integers."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<long>")).alias("i", "value"))


def images(spark: SparkSession, folder: str, pattern: str = r"cam\d+_(\d+)\.jpg$") -> DataFrame:
    """(path, ts_ns) of images named after their time; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return rows.where(F.col("path").rlike(pattern)).select("path", F.regexp_extract("path", pattern, 1).cast("long").alias("ts_ns"))


def paired_chunks(files: DataFrame) -> DataFrame:
    """(chunk, points, imu) of files (column path) by the last four characters of their stems; an
    unmatched side is null."""
    from pointloom.functions.geometry import chunk_index

    f = files.withColumn("chunk", chunk_index("path"))
    ext = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    return f.groupBy("chunk").agg(F.min(F.when(ext.isin("las", "laz"), F.col("path"))).alias("points"), F.min(F.when(ext == "csv", F.col("path"))).alias("imu"))


def pose_blocks(spark: SparkSession, path: str, inverse: bool = False) -> DataFrame:
    """(stem, pose) of blocks of five lines: a file name, then four rows of four numbers.  Joined to
    scans by the stem of their file; ``inverse`` inverts them."""
    from pointloom.functions.geometry import stem
    from pointloom.functions.pose import inverse as inverted

    text = spark.read.text(path, wholetext=True).select(F.filter(F.split(F.regexp_replace("value", r"\r", ""), r"\n"), lambda x: F.length(F.trim(x)) > 0).alias("l"))
    rows = text.where("size(l) >= 5").select("l", F.explode(F.sequence(F.lit(0), (F.floor(F.size("l") / 5) - 1).cast("int"))).alias("i"))
    pose = F.flatten(F.transform(F.slice("l", F.col("i") * 5 + 2, F.lit(4)), lambda x: numbers(x, r"\s+")))
    out = rows.select(stem(F.trim(F.element_at("l", F.col("i") * 5 + 1))).alias("stem"), pose.alias("pose"))
    return out.withColumn("pose", inverted("pose")) if inverse else out


def xyz_text(spark: SparkSession, paths: str | list[str], skip_first: bool = True) -> DataFrame:
    """(path, x, y, z) of text points with at least three columns; the first line of a file is its
    count and has fewer."""
    rows = lines(spark, paths).withColumn("v", numbers(F.col("line"))).where("size(v) >= 3" if skip_first else "size(v) > 0")
    rows = rows.select("path", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate("xyz")])
    return rows.where("x is not null and y is not null and z is not null")


def updated_poses(scans: DataFrame, poses: DataFrame) -> DataFrame:
    """Scans (scan_id, file_name, pose) with the poses of a list (stem, pose); others keep theirs."""
    from pointloom.functions.geometry import stem

    new = poses.select(F.col("stem").alias("__stem"), F.col("pose").alias("__pose"))
    out = scans.withColumn("__stem", stem("file_name")).join(new, "__stem", "left")
    return out.withColumn("pose", F.coalesce("__pose", "pose")).select(*scans.columns)
