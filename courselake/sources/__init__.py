"""Reading and writing: landing files, tables in the shared folder, the driver-table adapter."""
