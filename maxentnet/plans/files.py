"""Local files written without a shell: Hadoop starts ``chmod`` for every file, checksum file and folder that a task makes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

CLASS = "maxentnet.LocalFiles"
#: Hadoop's local files, with the same modes set by a system call. Where Hadoop has its native library it does so itself.
JAVA = """
package maxentnet;

import java.io.IOException;
import java.nio.file.Files;
import java.nio.file.attribute.PosixFilePermissions;
import org.apache.hadoop.fs.LocalFileSystem;
import org.apache.hadoop.fs.Path;
import org.apache.hadoop.fs.RawLocalFileSystem;
import org.apache.hadoop.fs.permission.FsPermission;

public class LocalFiles extends LocalFileSystem {
  public LocalFiles() { super(new Raw()); }

  public static class Raw extends RawLocalFileSystem {
    public void setPermission(Path path, FsPermission mode) throws IOException {
      String letters = mode.getUserAction().SYMBOL + mode.getGroupAction().SYMBOL + mode.getOtherAction().SYMBOL;
      Files.setPosixFilePermissions(pathToFile(path).toPath(), PosixFilePermissions.fromString(letters));
    }
  }
}
"""
_SHIPPED: set[str] = set()


def options(spark: SparkSession, path: str) -> dict[str, str]:
    """What a writer of ``path`` must be told so that no shell is started; nothing for other stores. Compiles and ships the class at a session's first call."""
    hadoop = spark._jsc.hadoopConfiguration()
    scheme = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(hadoop).getUri().getScheme()
    if scheme != "file" or hadoop.get("fs.file.impl") or spark._jvm.org.apache.hadoop.io.nativeio.NativeIO.isAvailable():
        return {}
    session = spark._jsparkSession.sessionUUID()
    if session not in _SHIPPED:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(hadoop.getClassLoader())
        compiler.cook(JAVA)
        codes = compiler.getBytecodes()
        jar = f"{tempfile.mkdtemp(prefix='maxentnet-jar-')}/files-{uuid.uuid4().hex}.jar"
        with zipfile.ZipFile(jar, "w") as out:
            for entry in codes:
                out.writestr(entry.replace(".", "/") + ".class", bytes(codes[entry]))
        spark.sql(f"ADD JAR '{jar}'")  # the driver serves it to executors
        hadoop.setClassLoader(compiler.getClassLoader())
        _SHIPPED.add(session)
    return {"fs.file.impl": CLASS, "fs.file.impl.disable.cache": "true"}
