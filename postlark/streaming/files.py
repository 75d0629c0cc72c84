"""Directory calls on whatever file system a path belongs to, through Hadoop's API.

They need a classic session: Spark Connect has no access to the JVM.
"""

import hashlib
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Directory:
    """A directory and its direct entries."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._files = self._hadoop.Path(path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return list(self.times(name))

    def times(self, name: str = "") -> dict[str, float]:
        """When each entry was last changed, in seconds by the file system's clock: one
        listing. Only files have such a time on every file system."""
        try:
            found = self._files.listStatus(self._at(name))
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() == "FileNotFoundException":
                return {}
            raise
        return {one.getPath().getName(): one.getModificationTime() / 1000 for one in found}

    def fingerprint(self) -> str:
        """A name for the state of a file, or of all files below a directory: it changes
        when one of them is added, removed or written again."""
        found, files = [], self._files.listFiles(self._at(""), True)
        while files.hasNext():
            one = files.next()
            found.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
        return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:32]

    def size(self, name: str = "") -> int:
        """Bytes of a file, or of all files below a directory."""
        return self._files.getContentSummary(self._at(name)).getLength()

    def create(self, name: str = "") -> None:
        self._files.mkdirs(self._at(name))

    def _write(self, stream, text: str) -> None:
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def put(self, name: str, text: str = "") -> None:
        """Write a small file, replacing one of that name."""
        self._write(self._files.create(self._at(name), True), text)

    def text(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Write a small file whole, unless there is one of that name: says whether it did.

        Of several writers exactly one succeeds, and no reader sees half a file. A local
        disk links a finished file to its name, an S3 store is asked for a conditional
        write, and other file systems rename without replacing, as HDFS does atomically.
        """
        scheme = self._files.getUri().getScheme()
        if scheme == "file":
            return self._link(name, text)
        try:
            if scheme == "s3a":
                builder = self._files.createFile(self._at(name)).recursive().overwrite(False)
                builder.must("fs.option.create.conditional.overwrite", "true")
                self._write(builder.build(), text)
                return True
            return self._rename(name, text)
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise

    def _hidden(self, name: str) -> str:
        folder, _, last = name.rpartition("/")
        return f"{folder}/.{last}-{uuid.uuid4().hex}" if folder else f".{last}-{uuid.uuid4().hex}"

    def _link(self, name: str, text: str) -> bool:
        final = self._at(name).toUri().getPath()
        os.makedirs(os.path.dirname(final), exist_ok=True)
        draft = os.path.join(os.path.dirname(final), f".{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as file:
            file.write(text)
        try:
            os.link(draft, final)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)

    def _rename(self, name: str, text: str) -> bool:
        draft = self._hidden(name)
        self.put(draft, text)
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self._conf)
        kind = getattr(self._hadoop, "Options$Rename")
        try:
            context.rename(self._at(draft), self._at(name), self._gateway.new_array(kind, 0))
            return True
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        finally:
            self.remove(draft)

    def remove(self, name: str = "") -> None:
        self._files.delete(self._at(name), True)
