"""Training-data operators: personal data, near and exact copies, language, secrets, lines, benchmark leaks,
packing, licences and token counts.  Nothing outside this subpackage imports it."""
