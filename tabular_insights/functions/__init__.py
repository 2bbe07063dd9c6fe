from .columns import all_present, flag_expr, key_bucket

__all__ = ["all_present", "flag_expr", "key_bucket"]
