from .registration import register_stream

__all__ = ["register_stream"]
