"""Who may see what. The admin role is one viewer (`admin`), and so are all regular users
together (`public`, for the source everybody may see); single users are `user:<id>`."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlake.operators.tables import union_rows

ADMIN, PUBLIC = "admin", "public"


def viewer(user: Column) -> Column:
    return F.concat(F.lit("user:"), user.cast("string"))


def device_counts(users: DataFrame, devices: DataFrame) -> DataFrame:
    """Devices per user, 0 when none, most first."""
    n = devices.groupBy("user_id").agg(F.count(F.lit(1)).alias("device_count"))
    return (
        users.join(n, "user_id", "left")
        .withColumn("device_count", F.coalesce("device_count", F.lit(0)))
        .orderBy(F.col("device_count").desc(), "user_id")
    )


def accessible_sources(users, devices, generic, metrics, public: str = "system_monitor") -> DataFrame:
    """(viewer, source): admins see active devices and every seen sensor; users generic devices
    they created and devices they own, and, as the viewer `public`, the public source."""
    row = lambda df, v, s: df.select(v.alias("viewer"), s.alias("source"))
    admin, src = F.lit(ADMIN), F.col("source")
    regular = users.where(~F.col("is_admin")).select("user_id")
    created = generic.withColumnRenamed("created_by", "user_id").join(regular, "user_id", "left_semi")
    owned = devices.join(regular, "user_id", "left_semi")
    return union_rows([
        row(devices.where("is_active"), admin, src),
        row(generic.where("is_active"), admin, src),
        row(metrics.where(F.col("sensor_id") != "").select("sensor_id").distinct(), admin, F.col("sensor_id")),
        row(users.sparkSession.range(1), F.lit(PUBLIC), F.lit(public)),
        row(created.where(src != public), viewer(F.col("user_id")), src),
        row(owned.where(src != public), viewer(F.col("user_id")), src),
    ]).distinct()


def permitted_devices(permissions: DataFrame, generic: DataFrame) -> DataFrame:
    """(user_id, device_id, source) of active devices granted to a user; read either way round."""
    active = generic.where("is_active").select(F.col("id").alias("device_id"), "source")
    return permissions.select("user_id", "device_id").distinct().join(active, "device_id")


def visible_alerts(alerts: DataFrame, devices: DataFrame, access: DataFrame) -> DataFrame:
    """(viewer, alert id): owner of the device; without a device, whoever may see the source; admins all.

    An alert of the public source is one row of the viewer `public`, not one of every user.
    """
    a = alerts.select("id", "device_id", "source")
    own = devices.select(F.col("id").alias("device_id"), viewer(F.col("user_id")).alias("viewer"))
    users = access.where(F.col("viewer") != ADMIN)
    cols = ["viewer", "id"]
    return (
        a.where("device_id IS NOT NULL").join(own, "device_id").select(cols)
        .unionByName(a.where("device_id IS NULL").join(users, "source").select(cols))
        .unionByName(a.select(F.lit(ADMIN).alias("viewer"), "id"))
    )
