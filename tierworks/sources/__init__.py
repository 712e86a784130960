from tierworks.sources.layers import append_batch, layer_name, read_layer, write_layer  # noqa: F401
from tierworks.sources.raw import literal_table, read_raw_csv, read_tables, staging_inventory  # noqa: F401
