"""Column expressions; none of them needs Python at run time."""
