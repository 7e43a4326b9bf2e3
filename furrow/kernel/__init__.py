"""Loads the topology kernel (Java functions on WKB) into a running session.

The source is compiled once per driver process, by the compiler of the session's own JVM (a `javac`
program if that JVM has none), against the class path that this JVM runs on, so it does not matter
where Spark's jars lie.  The jar goes to a private folder of the process and to the session with
ADD JAR, which sends it to every executor.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import subprocess
import tempfile
import zipfile
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SOURCE = Path(__file__).with_name("Kernel.java")
FUNCTIONS = {
    "Rect": "binary", "FromWkt": "binary", "ToWkt": "string", "FromJson": "binary", "ToJson": "string", "Measure": "double", "Relate": "boolean",
    "Overlay": "binary", "Less": "binary", "Union": "binary", "Repair": "binary", "Polygons": "array<binary>", "LineParts": "array<binary>", "Buffer": "binary",
    "Shape": "binary", "Rotate": "binary", "Points": "array<array<double>>", "RingPoints": "array<array<double>>", "Plain": "string", "Canonical": "string", "Project": "binary", "Cluster": "array<int>", "Cover": "array<binary>", "CoverCopies": "array<binary>", "Sweep": "array<binary>", "Route": "binary",
}
# Classes of the three jars that the source needs: Spark SQL, the Scala library, JTS.
NEEDED = ("org.apache.spark.sql.api.java.UDF1", "scala.collection.Seq", "org.locationtech.jts.geom.Coordinate")
_LOADED: set[str] = set()
_JARS: dict[str, Path] = {}


class KernelError(RuntimeError):
    """The kernel could not be built."""


def class_path(spark: SparkSession) -> list[str]:
    """Where the session's JVM has its classes from: its class path and the places of the classes that are needed."""
    jvm = spark.sparkContext._jvm
    found = (jvm.java.lang.System.getProperty("java.class.path") or "").split(os.pathsep)
    loaders = [jvm.java.lang.Thread.currentThread().getContextClassLoader(), jvm.java.lang.ClassLoader.getSystemClassLoader()]
    for name in NEEDED:
        for loader in filter(None, loaders):
            try:
                source = loader.loadClass(name).getProtectionDomain().getCodeSource()
            except Exception:  # this loader does not know the class
                continue
            if source is not None and source.getLocation() is not None:
                found.append(unquote(urlparse(source.getLocation().toString()).path))
                break
    homes = [os.environ.get("SPARK_HOME"), jvm.java.lang.System.getenv("SPARK_HOME")]
    found += [f"{h}/jars/*" for h in homes if h]
    return list(dict.fromkeys(f for f in found if f))


def _compile(spark: SparkSession, path: list[str], out: str) -> str | None:
    """None if it worked, else what the compiler says."""
    gateway = spark.sparkContext._gateway
    arguments = ["-nowarn", "--release", "17", "-cp", os.pathsep.join(path), "-d", out, str(SOURCE)]
    try:
        compiler = gateway.jvm.javax.tools.ToolProvider.getSystemJavaCompiler()
    except TypeError:  # a JVM without the compiler's interface
        compiler = None
    if compiler is not None:
        given = gateway.new_array(gateway.jvm.java.lang.String, len(arguments))
        for i, a in enumerate(arguments):
            given[i] = a
        said = gateway.jvm.java.io.ByteArrayOutputStream()
        # through the interface's method: the compiler's own class is not open to reflection
        run = next(m for m in gateway.jvm.java.lang.Class.forName("javax.tools.Tool").getMethods() if m.getName() == "run")
        values = gateway.new_array(gateway.jvm.java.lang.Object, 4)
        values[1] = values[2] = said
        values[3] = given
        return None if run.invoke(compiler, values) == 0 else said.toString()
    program = os.path.join(gateway.jvm.java.lang.System.getProperty("java.home") or "", "bin", "javac")
    program = program if os.path.exists(program) else shutil.which("javac")
    if program is None:
        return "this JVM has no compiler and there is no javac program"
    done = subprocess.run([program, *arguments], capture_output=True, text=True)
    return done.stderr or "javac failed" if done.returncode else None


def jar(spark: SparkSession) -> Path:
    """The kernel's jar; built at the first call in this process."""
    digest = hashlib.sha256(SOURCE.read_bytes()).hexdigest()[:16]
    if digest not in _JARS:
        folder = tempfile.mkdtemp(prefix="furrow-kernel-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path, classes = class_path(spark), os.path.join(folder, "classes")
        os.mkdir(classes)
        if (said := _compile(spark, path, classes)) is not None:
            places = "\n  ".join(path)
            raise KernelError(f"the kernel does not compile; class path searched:\n  {places}\n{said}")
        target = Path(folder) / f"furrow-kernel-{digest}.jar"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(Path(classes).rglob("*.class")):
                z.write(f, f.relative_to(classes))
        _JARS[digest] = target
    return _JARS[digest]


def load(spark: SparkSession) -> None:
    """Register all kernel functions as furrow_<name>; once per session."""
    session = f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}"
    if session not in _LOADED:
        spark.sql(f"ADD JAR '{jar(spark)}'")
        for name, kind in FUNCTIONS.items():
            spark.udf.registerJavaFunction(f"furrow_{name}", f"furrow.Kernel${name}", kind)
        _LOADED.add(session)


def call(name: str, *args: Column | str | float | bool) -> Column:
    """Kernel function as a column expression; strings are column names."""
    return F.call_function(f"furrow_{name}", *[F.col(a) if isinstance(a, str) else a if isinstance(a, Column) else F.lit(a) for a in args])
