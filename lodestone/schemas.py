"""Table schemas; declared, never inferred."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "t": T.TimestampType(), "b": T.BooleanType(), "as": T.ArrayType(T.StringType()), "af": T.ArrayType(T.FloatType()), "al": T.ArrayType(T.LongType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split(":") for f in spec.split())])


FILES = _struct("path:s language:s graph_language:s text:s length:l modified_at:t")
CHUNKS = _struct("id:s path:s language:s start_line:i end_line:i text:s hash:s modified_at:t")
INDEXED = _struct("chunk_idx:l id:s path:s language:s start_line:i end_line:i text:s hash:s modified_at:t vector:af bits:al")
SYMBOLS = _struct("id:s name:s qualified_name:s kind:s file_path:s start_line:i end_line:i language:s signature:s parent_id:s chunk_id:s")
EDGES = _struct("source_id:s target_id:s kind:s metadata:s")
IMPORTS = _struct("source_file:s target_path:s alias:s line:i is_type_only:b")
METADATA = _struct("version:i repo_path:s repo_hash:s vector_dim:i indexed_at:t total_files:l total_chunks:l embedding_model:s")
CHANGES = _struct("path:s op:s ts:t")
REMOTE_ROWS = _struct("id:s path:s start_line:i end_line:i content:s language:s symbols:as vector:af")
