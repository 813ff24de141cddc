"""The few file system calls a batch job needs, on any file system Spark can reach."""


def _file_system(spark, path):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return target.getFileSystem(conf), target


def path_exists(spark, path):
    file_system, target = _file_system(spark, path)
    return file_system.exists(target)


def delete_path(spark, path):
    file_system, target = _file_system(spark, path)
    return file_system.delete(target, True)


def path_bytes(spark, path):
    """Bytes of all files below a path."""
    file_system, target = _file_system(spark, path)
    return file_system.getContentSummary(target).getLength()


def shared_dir(spark):
    """Folder every executor can reach: the one the cluster names, or a fresh local one.

    The local fallback is for single-machine runs such as tests, where nothing is named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
    import tempfile

    fresh = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


def cut_lineage(df):
    """Reliable checkpoint of a frame, for loops whose plan would grow."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
