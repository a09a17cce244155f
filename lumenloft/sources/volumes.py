"""Mounted volumes from the output of the systems' own tools, as rows of schemas.VOLUME.

Each parser takes a DataFrame with the tool's output; trees are walked by a bounded number of explodes, so a poll of many
hosts is one job."""

from __future__ import annotations

import os
import plistlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloft import schemas
from lumenloft.functions.core import boolean_fact, safe_capacity

#: File systems without media, buses of removable media, and mount points of the system.
PSEUDO = ("proc", "sysfs", "devtmpfs", "devfs", "tmpfs", "cgroup", "cgroup2", "overlay", "squashfs", "tracefs", "debugfs")
BUSES = ("usb", "mmc", "sd")
SYSTEM = ("/", "/boot", "/boot/efi", "/usr", "/var")
#: Attributes that the kernel shows of an SD card, and the facts that they become.
SD_FACTS = {"oemid": "sdOemId", "manfid": "sdManufacturerId", "serial": "sdSerial", "date": "sdManufactureDate", "prv": "sdProductRevision"}
DEPTH = 6
_FIELDS = ("name", "rm", "hotplug", "tran", "uuid", "label", "fstype", "size", "vendor", "model", "mountpoint", "path", "type")


def _node(depth: int) -> str:
    own = ", ".join(f"{f} string" for f in _FIELDS) + ", mountpoints array<string>"
    return f"struct<{own.replace(' string', ':string').replace('mountpoints array', 'mountpoints:array')}" + (f", children:array<{_node(depth - 1)}>>" if depth else ">")


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def is_system_mount(mount: Column, system=SYSTEM) -> Column:
    """A mount point of the system or below one; nothing is below the root in this sense."""
    m = F.regexp_replace(mount, "/+$", "")
    hit = m.isin("", *[s for s in system if s != "/"]) if "/" in system else m.isin(*system)
    for s in system:
        if s != "/":
            hit |= m.startswith(s + "/")
    return hit


def sd_facts(spark: SparkSession, disks: list[str], root: str = "/sys/class/block") -> DataFrame:
    """disk, name and the attributes of SD_FACTS of this host's SD cards, null where the kernel doesn't show them."""
    rows = []
    for disk in disks:
        row = [disk]
        for field in ("name", *SD_FACTS):
            try:
                with open(os.path.join(root, disk, "device", field)) as f:
                    row.append(f.read().strip() or None)
            except OSError:
                row.append(None)
        rows.append(tuple(row))
    return spark.createDataFrame(rows, "disk string, name string, " + ", ".join(f"{f} string" for f in SD_FACTS))


def linux_volumes(outputs: DataFrame, column: str = "lsblk", system=SYSTEM, sd: DataFrame | None = None) -> DataFrame:
    """From `lsblk --json --bytes`. Signals of a disk hold for its partitions; a disk any part of which is mounted as part
    of the system is left out whole. `sd` (the keys of outputs, disk, name and SD_FACTS) adds what the kernel tells of SD
    cards, for disks on the mmc bus; its name stands in for a missing model."""
    keys = [c for c in outputs.columns if c != column]
    top = outputs.select(*keys, F.monotonically_increasing_id().alias("_host"), F.posexplode(F.from_json(F.col(column), f"struct<blockdevices:array<{_node(DEPTH)}>>")["blockdevices"]).alias("_disk", "d"))
    rows = []
    level = top.select(*keys, "_host", "_disk", "d", F.lit(False).alias("removable"), F.lit(False).alias("hotplug"), *[F.lit(None).cast("string").alias(c) for c in ("transport", "vendor", "model")], F.col("d.name").alias("disk"))
    for i in range(DEPTH + 1):
        own = level.select(
            *keys, "_host", "_disk", "d", (F.col("removable") | F.coalesce(boolean_fact("d.rm"), F.lit(False))).alias("removable"), (F.col("hotplug") | F.coalesce(boolean_fact("d.hotplug"), F.lit(False))).alias("hotplug"),
            F.coalesce(F.lower(_blank(F.col("d.tran"))), "transport").alias("transport"), F.coalesce("vendor", _blank(F.col("d.vendor"))).alias("vendor"), F.coalesce("model", _blank(F.col("d.model"))).alias("model"), "disk",
        )
        mounts = F.array_distinct(F.filter(F.concat(F.coalesce("d.mountpoints", F.array().cast("array<string>")), F.array("d.mountpoint")), lambda m: m.isNotNull() & (m != "")))
        rows.append(own.select(*keys, "_host", "_disk", mounts.alias("mounts"), "removable", "hotplug", "transport", "vendor", "model", "disk", *[_blank(F.col(f"d.{f}")).alias(f) for f in ("label", "uuid", "fstype", "size", "path", "type")]))
        if i < DEPTH:
            level = own.select(*keys, "_host", "_disk", F.explode("d.children").alias("d"), "removable", "hotplug", "transport", "vendor", "model", "disk")
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    ours = F.exists("mounts", lambda m: is_system_mount(m, system))
    every = every.join(every.filter(ours).select("_host", "_disk").distinct(), ["_host", "_disk"], "left_anti")
    found = every.filter(F.col("removable") | F.col("hotplug") | F.col("transport").isin(*BUSES)).select("*", F.explode("mounts").alias("mount_path"))
    found = found.filter(F.col("mount_path").startswith("/") & (F.col("mount_path") != "/") & ~F.col("mount_path").rlike("^/(?:proc|sys|dev)/") & ~F.coalesce(F.lower("fstype").isin(*PSEUDO), F.lit(False)))
    told = {"removableDevice": F.col("removable").cast("string"), "hotplug": F.col("hotplug").cast("string"), "transport": F.col("transport"), "devicePath": F.col("path"), "deviceType": F.col("type")}
    if sd is not None:
        seen = sd.select(*keys, F.col("disk").alias("_sd"), F.col("name").alias("_name"), *SD_FACTS)
        at = (found["transport"] == "mmc") & (found["disk"] == F.col("_sd"))
        for k in keys:
            at &= found[k].eqNullSafe(seen[k])
        found = found.join(seen, at, "left").select(*[found[c] for c in found.columns if c != "model"], F.coalesce(found["model"], _blank(F.col("_name"))).alias("model"), *SD_FACTS)
        told |= {fact: _blank(F.col(field)) for field, fact in SD_FACTS.items()}
    facts = F.map_filter(F.create_map(*[x for k, v in told.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return found.select(
        *keys, F.lit("removable-volume").alias("source_type"), "mount_path", F.coalesce("label", F.element_at(F.split("mount_path", "/"), -1)).alias("display_name"), F.col("label").alias("volume_label"), F.col("uuid").alias("platform_volume_id"), F.col("fstype").alias("fs_type"),
        safe_capacity("size").alias("capacity_bytes"), F.col("vendor").alias("device_vendor"), F.col("model").alias("device_model"), F.lit(True).alias("removable"), facts.alias("raw_facts"),
    ).dropDuplicates([*keys, "mount_path"])


_WINDOWS = "Path string, VolumeGuid string, DeviceID string, AccessPaths string, DriveLetter string, MountPoints string, Label string, FileSystem string, Capacity string, DriveType string, SerialNumber string, BusType string, Manufacturer string, Model string, IsRemovable string, IsBoot string, IsSystem string"


def windows_volumes(outputs: DataFrame, column: str = "volumes") -> DataFrame:
    """From a JSON object or array of volumes. Boot and system volumes, and those said not to be removable, are left out."""
    keys = [c for c in outputs.columns if c != column]
    kind = f"array<struct<{_WINDOWS.replace(' string', ':string')}>>"
    text = F.trim(F.col(column))
    v = outputs.select(*keys, F.explode(F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), kind)).alias("v")).select(*keys, "v.*")
    no, own = F.lit(False), boolean_fact("IsRemovable")
    drive, bus = F.lower("DriveType"), F.lower("BusType")
    guess = F.coalesce(drive.isin("2", "removable"), no) | F.coalesce(bus.isin(*BUSES), no)
    v = v.filter(~F.coalesce(boolean_fact("IsBoot"), no) & ~F.coalesce(boolean_fact("IsSystem"), no) & F.coalesce(own, guess))
    listed = lambda c: F.coalesce(F.from_json(F.col(c), "array<string>"), F.array(F.col(c)))
    access = F.filter(F.concat(listed("AccessPaths"), listed("DriveLetter"), listed("MountPoints")), lambda p: p.rlike(r"^[A-Za-z]:\\(?:.+\\)?$|^\\\\[^\\]+\\[^\\]+\\"))
    v = v.select("*", F.explode(access).alias("p")).withColumn("mount_path", F.when(F.col("p").rlike("^[A-Za-z]:"), F.concat(F.upper(F.left("p", F.lit(1))), F.substring("p", F.lit(2), F.length("p")))).otherwise(F.col("p")))
    guid = F.coalesce(*[F.when(F.col(c).rlike(r"(?i)^\\\\\?\\Volume\{[^}]+\}\\?$"), F.col(c)) for c in ("VolumeGuid", "Path", "DeviceID")])
    bare = F.regexp_replace("mount_path", r"\\+$", "")
    out = v.select(
        *keys, F.lit("removable-volume").alias("source_type"), "mount_path", F.coalesce(_blank(F.col("Label")), F.element_at(F.split(bare, r"\\"), -1)).alias("display_name"), _blank(F.col("Label")).alias("volume_label"),
        F.coalesce(guid, F.concat(F.lit("serial:"), _blank(F.col("SerialNumber")))).alias("platform_volume_id"), _blank(F.col("FileSystem")).alias("fs_type"), safe_capacity("Capacity").alias("capacity_bytes"), _blank(F.col("Manufacturer")).alias("device_vendor"), _blank(F.col("Model")).alias("device_model"),
        F.lit(True).alias("removable"), F.map_filter(F.create_map(F.lit("busType"), F.col("BusType"), F.lit("volumeGuidPath"), F.col("Path")), lambda k, x: x.isNotNull()).alias("raw_facts"), F.lower(bare).alias("_same"),
    )
    return out.dropDuplicates([*keys, "_same"]).drop("_same")


def macos_volumes(spark: SparkSession, listing: bytes, infos: dict[str, bytes]) -> DataFrame:
    """From the property lists of `diskutil list` and of `diskutil info` for each mounted identifier: a poll of one host,
    read on the driver."""
    found: dict[str, str] = {}

    def collect(x):
        if isinstance(x, dict):
            if x.get("DeviceIdentifier") and x.get("MountPoint"):
                found[x["DeviceIdentifier"]] = x["MountPoint"]
            x = list(x.values())
        if isinstance(x, list):
            for y in x:
                collect(y)

    collect(plistlib.loads(listing))
    rows, failed = [], 0
    for name in found:
        try:
            i = plistlib.loads(infos[name])
        except Exception:  # noqa: BLE001  a volume that vanished or is malformed doesn't hide the others
            failed += 1
            continue
        mount = i.get("MountPoint")
        if i.get("Mounted") is False or not mount or mount == "/" or not (i.get("RemovableMedia") is True or i.get("Ejectable") is True or i.get("Internal") is False):
            continue
        label = i.get("VolumeName") or os.path.basename(mount)
        size = i.get("TotalSize")
        rows.append(("removable-volume", mount, label, label, i.get("VolumeUUID") or i.get("MediaUUID") or i.get("DiskUUID"), i.get("FilesystemName"), size if isinstance(size, int) and size >= 0 else None, None, i.get("MediaName") or None, True, {"deviceIdentifier": name}))
    if failed and not rows:
        raise RuntimeError("no removable volume could be read")
    return spark.createDataFrame(rows, schemas.VOLUME)


def folder_facts(spark: SparkSession, path: str, capacity: int | None = None, filesystem: str | None = None) -> DataFrame:
    """One row for a folder that the user chose."""
    root = os.path.realpath(path)
    if not os.path.isdir(root):
        raise NotADirectoryError(path)
    name = os.path.basename(root) or root
    return spark.createDataFrame([("folder", root, name, name, None, filesystem, capacity, None, None, False, {"selection": "manual"})], schemas.VOLUME)


def sort_volumes(volumes: DataFrame) -> DataFrame:
    return volumes.orderBy(F.collate("display_name", "en_USA"), F.collate("mount_path", "en_USA"))
