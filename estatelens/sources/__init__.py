"""Where relations come from: folders of files, reports, literal rows, SQL commands."""
