"""Column functions: casts, dates, text, numbers and identity hashing.

Everything here returns a ``Column`` built from Spark SQL functions, so it stays
inside the JVM and inside whole-stage code generation.
"""

from .casts import (coerce_number, clean_missing_text, epoch_ms_long, lenient_int,
                    strict_date, truthy_text, valid_crm_number, valid_crm_state)
from .dates import (age_text, age_years, date_of, day_diff, day_first_timestamp,
                    epoch_date_text, epoch_text, ms_text, year_diff)
from .numbers import (locale_decimal, locale_int, python_round, ratio, rate_band,
                      signed_text, sql_round)
from .privacy import hash_identity, hash_raw
from .text import (blank_label, fold_accents, fold_compat, format_key, key_value_lines,
                   like_pattern, normalise_breaks, regex_group, search_terms, strip,
                   truncate_label, unify_breaks)
