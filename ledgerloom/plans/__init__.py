"""Every operator as a named query over the sample tables, with equivalent SQL."""
