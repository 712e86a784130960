from tierworks.functions.exprs import (  # noqa: F401
    StatusLabels,
    achievement,
    as_bool,
    blank,
    code_lookup,
    flag_count,
    grain_id,
    half_up,
    mean_of,
    percent,
    period_id,
    quota_status,
    ratio,
    year_of,
)
from tierworks.functions.names import layer_of, qualified_name, table_part  # noqa: F401
