


def register(spark) -> list[str]:
    """Registers the functions that SQL lacks with a session, by name; gives the names."""
    from . import hashing

    for name, function in {"fnv1": hashing.fnv1_udf, "adler32": hashing.adler32}.items():
        spark.udf.register(name, function)
    return ["fnv1", "adler32"]
